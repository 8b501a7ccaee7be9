"""The manifest against SQL and against a tree built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def hand_leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def hand_tree(leaves):
    """(top, the siblings of each leaf as (left, right), level by level)."""
    level, where, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, at in enumerate(where):
            run = at - at % 3
            paths[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
            where[k] = at // 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def by_hand(rows):
    own = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        honest = hand_leaf(doc_id, source, lang, n_chars, text)
        told = honest if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 2 else hand_leaf(doc_id, source, lang, n_chars, text.replace("\n", ""))
        own[source].append((doc_id is not None, doc_id or 0, honest, doc_id, told))
    order = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: hand_tree([r[2] for r in sorted(own[s], key=lambda r: r[:3])]) for s in own}
    root, over = hand_tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, over, strict=True):
        for (_, _, honest, doc_id, told), path in zip(sorted(own[s], key=lambda r: r[:3]), trees[s][1], strict=True):
            value = told
            for left, right in path + above:
                value = sha(left, value, right)
            out.append((-1 if doc_id is None else doc_id, honest, trees[s][0], root, sha(*[x for p in path + above for x in p]), value, value == root))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.folded_root == r.root) for r in df.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, part int, leaf string"


def proofs_of(spark, rows):
    from folioflow.llm import merkle_manifest as m

    docs = spark.createDataFrame([(*r, "t", 1, "l") for r in rows], SCHEMA)
    told = m.F.when(m.fold("doc_id", 2) == 0, m.F.replace("text", m.F.lit("\n"), m.F.lit(""))).otherwise(m.F.col("text"))
    return m.proofs(m.manifest(docs, m.leaf(*[m.F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], told)))


def test_query_equals_sql(spark, sf_dir):
    from oracle import compare, connect

    from folioflow.llm.merkle_manifest import op12_merkle_manifest
    from folioflow.llm.sql import OP12_SQL

    compare(spark, connect(sf_dir), op12_merkle_manifest, OP12_SQL, sf_dir)


@pytest.mark.parametrize("meet", [2, 64])
def test_stretches_and_merging(spark, monkeypatch, meet):
    """A hot source over several stretches, lone rows, null ids and sources, repeated rows, long texts, more rounds."""
    from folioflow.llm import merkle_manifest as m

    monkeypatch.setattr(m, "MEET", meet)
    rng = random.Random(4)
    rows = [(i, f"text {i}\n{i % 7}", rng.choice(["en", None]), rng.choice(["hot", "hot", None, "b", "ü"]), i) for i in range(211)]
    rows += [(None, None, None, None, None), (None, "x", "en", "hot", 1), (5, "again", "en", "hot", 5), (5, "again", "en", "hot", 5), (900, "", "en", "lone", 0), (901, "\n" * 9, "en", "alone", 9), (902, "y" * 200_000, "en", "b", 3)]
    assert found(proofs_of(spark, rows)) == by_hand(rows)


def test_small_tables(spark):
    row = (1, "a\nb", "en", "s", 3)
    for rows in ([row], [row, row], [(2, "t", None, None, None), row], [(i, "t", "en", "s", 1) for i in range(10)]):
        assert found(proofs_of(spark, rows)) == by_hand(rows)
    from folioflow.llm import merkle_manifest as m

    assert m.proofs(m.manifest(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 82])
def test_mountains(n):
    """However a row of leaves is cut, the nodes made and merged are those of the whole."""
    from folioflow.llm.merkle_manifest import Mountains

    leaves = [str(i) for i in range(n)]
    top, _ = hand_tree(leaves)
    rng = random.Random(n)
    for _ in range(20):
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(rng.randint(0, 5)))})
        edges, made = [], {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = Mountains(n)
            for i in range(a, b):
                m.push(0, i, leaves[i])
            m.close()
            edges += m.edges
            made |= {(level, i): v for level, i, v in m.made}
        last = Mountains(n)
        for level, i, v in sorted(edges, key=lambda e: e[1] * 3 ** e[0]):
            last.push(level, i, v)
        made |= {(level, i): v for level, i, v in last.made}
        assert (made[max(made)] if made else leaves[0]) == top
        assert len(made) == sum(-(-n // 3**k) for k in range(1, 9) if -(-n // 3 ** (k - 1)) > 1)
