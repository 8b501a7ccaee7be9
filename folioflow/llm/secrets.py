"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match
satisfies. Each block of texts is indexed once: postings of just the trigrams that some query asks
for. A rule's candidates are its query evaluated on postings; its expression then runs on those
alone. A rule from which no mandatory trigram follows runs on every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import documents, own_name, ship, text_udf


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group has at least so many characters.
    group: int = 0
    least: int = 1


#: What quotes, comments and lists set around a line; one end of a line, in a text or escaped in a string; a base64 digit.
_EDGE, _END, _DIGIT = r"""[\x20\t"'`>#*|,;+]*+""", r"(?:\r?\n|\r|\\r\\n|\\n)", r"(?:[A-Za-z0-9+/]|\\/)"
_LINE, _BREAK = _EDGE + _END + _EDGE, rf"(?:{_EDGE}(?:{_END}{_EDGE})++|[\x20\t]++)"
#: A private key: its header; then all to its END line, unless another begins or ends first; or else the attributes that
#: may precede a body, and of the body lines of base64 alone and runs of it that no word is.
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:(?:{_LINE}[A-Z][A-Za-z-]*+:\x20(?:[^\r\n\\]|\\(?![rn]))*+)++(?:{_LINE})?)?"
    rf"(?:{_LINE}{_DIGIT}++=*+(?=[\x20\t\"'`|,;+]*+(?:{_END}|\Z))|{_BREAK}(?:(?=[A-Za-z+/]*[0-9+/]){_DIGIT}{{16,}}+=*+|{_DIGIT}++=++(?![A-Za-z0-9])))++"
    r"|)"
)

#: The base kinds, in the order in which they are listed.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of 24 or more
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", PEM),
]
RULES = BASE_RULES + MORE_RULES

#: Strings that an expression's part may stand for, at most; beyond it the part says nothing.
MOST_STRINGS = 64

# a query is None (any text), a trigram, or ("and" | "or", queries)


def _all(queries) -> object:
    parts = tuple(dict.fromkeys(q for q in queries if q is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(queries) -> object:
    parts = tuple(dict.fromkeys(queries))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", parts)


def _spelled(strings: set[str]) -> object:
    """A text has one of the strings."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) if len(s) >= 3 else None for s in sorted(strings))


def _cross(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x in a for y in b}


def _fold(code: int) -> str | None:
    return chr(code).lower() if code < 128 else None


def _part(op, arg) -> tuple[set[str] | None, object]:
    """(the strings it stands for, if few; else None and a query)."""
    if op is sre.LITERAL:
        c = _fold(arg)
        return ({c}, None) if c else (None, None)
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            codes = [x] if kind is sre.LITERAL else range(x[0], x[1] + 1) if kind is sre.RANGE else None
            if codes is None or len(codes) > 26 or any(c >= 128 for c in codes):
                return None, None
            chars |= {_fold(c) for c in codes}
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in found) and len(union := set().union(*(e for e, _ in found))) <= MOST_STRINGS:
            return union, None
        return None, _any(_spelled(e) if e is not None else q for e, q in found)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, query = _sequence(inner)
        if least == 0:
            return (exact | {""}, None) if most == 1 and exact is not None else (None, None)
        if exact is not None and least == most == 1:
            return exact, None
        return None, _spelled(exact) if exact is not None else query
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, None
    return None, None


def _sequence(parts) -> tuple[set[str] | None, object]:
    run, exact, queries = {""}, True, []
    for op, arg in parts:
        strings, query = _part(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = _cross(run, strings)
            continue
        queries.append(_spelled(run))
        exact = False
        run = strings if strings is not None else {""}
        queries.append(query)
    return (run, None) if exact else (None, _all([*queries, _spelled(run)]))


def trigram_query(pattern: str) -> object:
    """A Boolean query over lower-case ASCII trigrams that holds for every text with a match; None: any text."""
    exact, query = _sequence(sre_parse.parse(pattern, re.ASCII))
    return _spelled(exact) if exact is not None else query


def trigrams(query: object) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


class Index:
    """Postings of wanted trigrams in a block of texts."""

    def __init__(self, wanted: list[str]):
        self.row = {t: i + 1 for i, t in enumerate(wanted)}
        self.table = np.zeros(1 << 21, np.uint16)
        for t, i in self.row.items():
            a, b, c = t.encode()
            self.table[a << 14 | b << 7 | c] = i
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.lower[128:] = 0  # no wanted trigram has byte 0

    def postings(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of texts for each trigram; one that straddles two texts may be noted for the first."""
        found = np.zeros((len(self.row) + 1, len(offsets) - 1), bool)
        if len(buf) >= 3:
            b = self.lower[buf].astype(np.int32)
            which = self.table[b[:-2] << 14 | b[1:-1] << 7 | b[2:]]
            at = np.flatnonzero(which)
            found[which[at], np.searchsorted(offsets, at, side="right") - 1] = True
        return found

    def candidates(self, query: object, postings: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.row[query]]
        parts = [self.candidates(q, postings) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.expressions = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = Index(sorted(set().union(*(trigrams(q) for q in self.queries))))

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), ascending; code points."""
        postings = self.index.postings(buf, offsets)
        raw = buf.tobytes()
        where = [self.index.candidates(q, postings) for q in self.queries]
        out = []
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text, spans = None, []
            for k, rule in enumerate(self.rules):
                if where[k][d]:
                    if text is None:
                        text = raw[a:b].decode()
                    for m in self.expressions[k].finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans.append((m.start(), k, m.end()))
            out.append(sorted(spans))
        return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])


def _finder(rules: list[Rule]):
    held: list[Scanner] = []

    def work(buf: np.ndarray, offsets: np.ndarray) -> list:
        if not held:
            held.append(Scanner(rules))
        return [[[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans] for spans in held[0].scan(buf, offsets)]]

    return text_udf(work, _FOUND)


def with_secrets(docs: DataFrame, rules: list[Rule] = RULES, name: str = "secrets") -> DataFrame:
    """`docs` with the secrets of each whole text: kind, start, end in code points, by start, then rule.

    Null or empty text has none; texts of any length are searched whole; rows repeated are searched alike. A column
    of that name is replaced, others pass through. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    return docs.withColumn(name, _finder(rules)("text")["spans"])


def _redactor(rules: list[Rule]):
    held: list[Scanner] = []

    def work(buf: np.ndarray, offsets: np.ndarray) -> list:
        if not held:
            held.append(Scanner(rules))
        raw, out = buf.tobytes(), []
        for spans, a, b in zip(held[0].scan(buf, offsets), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if not spans:
                out.append(None)
                continue
            text, parts, at = raw[a:b].decode(), [], 0
            for start, k, end in spans:
                if start >= at:
                    parts += [text[at:start], f"[{rules[k].kind}]"]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]))
        return [out]

    return text_udf(work, T.StructType([T.StructField("text", T.StringType())]))


def redact(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """`docs` with each secret replaced by its kind in brackets, spans that overlap by the first one's; n_chars, if there, follows the text.

    Texts without secrets, null and empty ones stay as they are; texts of any length are searched whole. Columns and
    rows stay, repeated ones too. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    new = own_name(docs, "clean")
    out = docs.withColumn(new, _redactor(rules)("text")["text"])
    changes = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.char_length(new).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(changes).drop(new)


_DIGEST = T.StructType([*(T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE_RULES), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.arrow_udf(_DIGEST)
def digest(spans: pa.Array) -> pa.Array:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    out = []
    for row in spans.to_pylist():
        said = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in row]
        counts = {f"n_{k}": sum(x == k for x, _ in said) for k in base}
        out.append(counts | {"base_sha256": hashlib.sha256(",".join(x for k, x in said if k in base).encode()).hexdigest(), "spans": ",".join(x for _, x in said)})
    return pa.array(out, pa.struct([*((f"n_{k}", pa.int64()) for k in base), ("base_sha256", pa.string()), ("spans", pa.string())]))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", digest("secrets").alias("d"))
    return found.select("doc_id", "d.*")
