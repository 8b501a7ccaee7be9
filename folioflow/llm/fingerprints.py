"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every five-word shingle hash below a fixed fraction of the hash space. A text that
would retain fewer than `LEAST` keeps its `LEAST` smallest instead (all, if it has no more), with the
threshold that amounts to written in front. Two sketches are compared below the smaller threshold, so
very unequal texts compare, and a union below it is the sketch of the texts together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import arrow_schema, documents, ship, text_udf
from folioflow.llm.text import shingles, slices, text_buffers, word_hashes

SIZE = 5
#: Hashes have this many bits; one in FRACTION of them is retained.
BITS, FRACTION, LEAST = 48, 8, 64
_ALL = 1 << BITS


class Sketch:
    """theta: every shingle hash below it is retained; hashes: those, ascending."""

    __slots__ = ("hashes", "theta")

    def __init__(self, theta: int, hashes: np.ndarray):
        self.theta, self.hashes = theta, hashes

    @classmethod
    def of(cls, grams: np.ndarray) -> Sketch:
        """From a text's distinct 64-bit shingle hashes, ascending."""
        h = np.unique(grams >> np.uint64(64 - BITS))
        theta = _ALL // FRACTION
        n = int(np.searchsorted(h, np.uint64(theta)))
        if n < LEAST:
            n = min(LEAST, len(h))
            theta = int(h[n]) if n < len(h) else _ALL
        return cls(theta, h[:n])

    def text(self) -> str:
        """Threshold in hex, a colon, the hashes as big-endian 6-byte numbers in base64."""
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
        return f"{self.theta:013x}:{base64.b64encode(raw).decode()}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        theta, _, raw = text.partition(":")
        six = np.frombuffer(base64.b64decode(raw), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(six), 8), np.uint8)
        wide[:, 2:] = six
        return cls(int(theta, 16), wide.view(">u8").reshape(-1).astype(np.uint64))

    def common(self, other: Sketch) -> tuple[int, int, int]:
        """Retained hashes in both, in this, in the other, below the smaller threshold."""
        theta = np.uint64(min(self.theta, other.theta))
        a, b = self.hashes, other.hashes
        a, b = a[: np.searchsorted(a, theta)], b[: np.searchsorted(b, theta)]
        return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; two texts without words are alike."""
        both, a, b = self.common(other)
        if a + b == 0:
            return float(self.theta == other.theta == _ALL)
        return both / (a + b - both)

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other has; 1 for a text without words."""
        both, a, _ = self.common(other)
        return both / a if a else float(self.theta == _ALL and not len(self.hashes))

    def merged(self, other: Sketch) -> Sketch:
        theta = min(self.theta, other.theta)
        h = np.union1d(self.hashes, other.hashes)
        return Sketch(theta, h[: np.searchsorted(h, np.uint64(theta))])


def sketches(buf: np.ndarray, offsets: np.ndarray) -> list[Sketch]:
    return [Sketch.of(g) for g in shingles(*word_hashes(buf, offsets), SIZE)]


def _fingerprint(buf: np.ndarray, offsets: np.ndarray) -> list:
    return [[s.text() for s in sketches(buf, offsets)]]


_fingerprint_udf = text_udf(_fingerprint, T.StructType([T.StructField("fingerprint", T.StringType())]))


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of each whole text; null counts as empty. A column of that name is replaced.

    Texts of any length are sketched whole; rows repeated have equal fingerprints; equal hashes count once. Other
    columns pass through. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    return docs.withColumn(name, _fingerprint_udf("text")["fingerprint"])


@F.arrow_udf(T.StructType([T.StructField("likeness", T.DoubleType()), T.StructField("contained", T.DoubleType())]))
def compare(left: pa.Array, right: pa.Array) -> pa.Array:
    """Likeness of two fingerprints, and the share of the left's shingles in the right; null if either is null."""
    out = []
    for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(None)
        else:
            a, b = Sketch.parse(x), Sketch.parse(y)
            out.append({"likeness": a.likeness(b), "contained": a.containment(b)})
    return pa.array(out, pa.struct([("likeness", pa.float64()), ("contained", pa.float64())]))


EDITED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("contained_next", T.DoubleType()),
])


def _string_sketches(texts: list[str]) -> list[Sketch]:
    return sketches(*text_buffers(pa.array(texts, pa.large_string())))


def _edit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each bucket ending with the first row of the next as a halo."""
    schema = arrow_schema(EDITED)
    held: list[tuple] = []
    for batch in batches:
        for rows, _, _ in slices(batch):
            held += zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), rows["halo"].to_pylist(), strict=True)
            if len(held) > 1:
                yield _edit(held, schema)
                held = held[-1:]


def _edit(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """All but the last row, each with the one after it."""
    texts = [t or "" for _, t, _ in held]
    keep = [i for i in range(len(held) - 1) if not held[i][2]]
    edited = []
    for i in keep:
        t, k = texts[i], len(texts[i]) // 4
        edited.append(t[: len(t) - k] + texts[i + 1][:k])
    own, new = _string_sketches(texts), _string_sketches(edited)
    columns = [
        [held[i][0] for i in keep], [len(texts[i]) for i in keep], [hashlib.sha256(x.encode()).hexdigest() for x in edited],
        [own[i].text() for i in keep], [x.text() for x in new],
        [own[i].likeness(x) for i, x in zip(keep, new, strict=True)], [own[i].likeness(own[i + 1]) for i in keep], [own[i].containment(own[i + 1]) for i in keep],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint against those of its edited text and of the next document.

    Next is by ascending doc_id (null first, then by text where ids repeat), after the last the first; a
    single document is its own next. Null text counts as empty. An empty table gives an empty one. Of further
    columns of `docs` none is kept.
    One shuffle deals the texts out by ranges of doc_id; the first row of each range is sent to the range
    before as well. Only one id a range comes to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(key.alias("k"))
    splits = np.unique(np.array(ids.stat.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [], dtype=np.float64))

    @F.arrow_udf("int")
    def bucket_of(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(splits, k.to_numpy().astype(np.float64), side="right"), pa.int32())

    firsts = ids.groupBy(bucket_of("k").alias("b")).agg(F.min("k").alias("k")).orderBy("b").collect()
    first_keys = np.array(sorted(r.k for r in firsts), dtype=np.int64)
    before = np.roll(np.array([r.b for r in firsts], dtype=np.int32), 1)

    @F.arrow_udf("int")
    def halo_of(k: pa.Array) -> pa.Array:
        """The bucket before, for a key that is the first of its bucket; else null."""
        k = k.to_numpy()
        at = np.minimum(np.searchsorted(first_keys, k), len(first_keys) - 1)
        return pa.array(before[at], pa.int32(), mask=first_keys[at] != k)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("k"))
    places = F.array_compact(F.array(F.struct(bucket_of("k").alias("b"), F.lit(False).alias("halo")), F.when(halo_of("k").isNotNull(), F.struct(halo_of("k").alias("b"), F.lit(True).alias("halo")))))
    dealt = rows.select("doc_id", "text", "k", F.explode(places).alias("p")).select("doc_id", "text", "k", "p.b", "p.halo")
    return dealt.repartition(n, "b").sortWithinPartitions("b", "halo", "k", "text").select("doc_id", "text", "halo").mapInArrow(_edit_rows, EDITED)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
