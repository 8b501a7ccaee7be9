"""The subpackage's queries and their SQL."""

from __future__ import annotations

from folioflow.llm.fingerprints import op2_fingerprints
from folioflow.llm.language_id import op1_language_id
from folioflow.llm.merkle_manifest import op12_merkle_manifest
from folioflow.llm.mixing import OP9_SQL, op9_mixing
from folioflow.llm.ngram_join import op6_ngram_join
from folioflow.llm.packing import op7_packing
from folioflow.llm.pii import op4_pii
from folioflow.llm.prefix_trie import op11_prefix_trie
from folioflow.llm.quality_classifier import op10_quality_classifier
from folioflow.llm.quality_rules import op8_quality_rules
from folioflow.llm.secrets import op5_secrets
from folioflow.llm.sql import OP3_SQL, OP6_SQL, OP11_SQL, OP12_SQL
from folioflow.llm.suffix_dedup import op3_suffix_dedup
from folioflow.llm.token_counts import op13_token_counts

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_fingerprints": op2_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_secrets": op5_secrets,
    "op6_ngram_join": op6_ngram_join,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_counts": op13_token_counts,
}

SQL = {"op3_suffix_dedup": OP3_SQL, "op6_ngram_join": OP6_SQL, "op9_mixing": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
