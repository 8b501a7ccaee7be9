"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Equal texts form classes. Class representatives meet in bands of their MinHash signatures; within a
band a pair is compared a few hashes at a time and dropped once the posterior probability that its
similarity reaches the threshold is below `TOLERANCE`. Survivors join classes into loose groups by
their spanning edges alone; a second round in each group prunes all its pairs in the same way and
verifies the rest on whole shingle sets. A pair of texts never becomes a row: groups return counts
and spanning edges. Large bands and groups are dealt out as pairs of bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import arrow_schema, discard, documents, own_name, ship, text_udf, written
from folioflow.llm.text import combine, mix, shingles, text_buffers, word_hashes

SIZE, THRESHOLD = 5, 0.8
#: BANDS bands of ROWS MinHash values: a pair at the threshold shares none with probability (1 - 0.8**6)**42, 3 in a million.
ROWS, BANDS = 6, 42
HASHES = ROWS * BANDS
#: A pair is dropped when its similarity reaches the threshold with less than this probability.
TOLERANCE = 1e-6
STEP = 42
#: Members of a block; a larger band or group becomes pairs of blocks.
BLOCK = 1024
#: Shingles of a block.
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(8191)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(n: int) -> int:
    """Fewest matches of n MinHash values, from a uniform prior, that leave the threshold likely enough."""
    total = 0.0
    for m in range(n + 1):
        # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
        total += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        if total >= TOLERANCE:
            return m
    return n


_LEAST = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def signature(grams: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, 16 bits of each."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(best, ((low[at : at + 512, None] ^ _XOR) * _MUL).min(axis=0), out=best)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


FEATURES = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType())])
_PACKED = T.StructType([T.StructField("grams", T.BinaryType())])


def _features(buf: np.ndarray, offsets: np.ndarray) -> list:
    n, sig = [], []
    for g in shingles(*word_hashes(buf, offsets), SIZE):
        n.append(len(g))
        sig.append(signature(g).tobytes() if len(g) else None)
    return [n, sig]


def _grams(buf: np.ndarray, offsets: np.ndarray) -> list:
    return [[g.tobytes() for g in shingles(*word_hashes(buf, offsets), SIZE)]]


_features_udf = text_udf(_features, FEATURES)
_grams_udf = text_udf(_grams, _PACKED)


def text_key(text: str | Column = "text") -> Column:
    """128 bits of a text's SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)), 1, 16)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(sig: pa.Array) -> pa.Array:
    """A 64-bit key for each band."""
    if not len(sig):
        return pa.array([], pa.list_(pa.int64()))
    values = np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(65537) + values[:, :, r] + np.uint64(1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * BANDS, pa.int32()), pa.array(key.reshape(-1).view(np.int64)))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key of each row; key -> id: least doc_id, copies, n_shingles, sig)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), _features_udf("text").alias("f")).select("doc_id", "key", "f.n_shingles", "f.sig")
    rows = written(rows, "join-rows")
    by_key = rows.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    return rows.select("doc_id", "key"), written(by_key, "join-classes")


def blocks(df: DataFrame, chunks: Column, by: list[str], member: str = "key") -> DataFrame:
    """Rows dealt to groups (by, i, j), i <= j: a group holds blocks i and j of the `chunks` that its members hash to."""
    df = df.withColumn("c", F.greatest(F.lit(1), F.ceil(chunks)).cast("int")).withColumn("own", F.pmod(F.xxhash64(member, F.lit(1)), F.col("c")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = df.withColumn("ij", F.explode(pairs)).select("*", "ij.i", "ij.j").drop("ij")
    return dealt.repartition(*by, "i", "j").sortWithinPartitions(*by, "i", "j", member)


def _groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    def rows():
        for b in batches:
            yield from b.to_pylist()

    for k, g in groupby(rows(), key=lambda r: tuple(r[c] for c in by)):
        yield k, list(g)


def survivors(sig: np.ndarray, a: int, others: np.ndarray) -> np.ndarray:
    """Those of `others` that stay candidates for row a after each step of hashes."""
    m = np.zeros(len(others), np.int64)
    at = 0
    for n, least in _LEAST:
        m += (sig[others, at:n] == sig[a, at:n]).sum(axis=1)
        keep = m >= least
        others, m, at = others[keep], m[keep], n
        if not len(others):
            break
    return others


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _partners(members: list[dict], i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member and those that it is held against: later ones of its own block, or the other block's. Every pair of a group comes in one (i, j) alone."""
    own = np.array([m["own"] for m in members])
    if i == j:
        for a in range(len(members) - 1):
            yield a, np.arange(a + 1, len(members))
    else:
        right = np.flatnonzero(own == j)
        if len(right):
            for a in np.flatnonzero(own == i).tolist():
                yield a, right


_EDGES = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _loose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the pairs in each band that survive."""
    schema = arrow_schema(_EDGES)
    out: list[tuple] = []
    for (_, i, j), members in _groups(batches, ["band", "i", "j"]):
        if len(members) < 2:
            continue
        sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint16).reshape(len(members), HASHES)
        forest = Forest(len(members))
        for a, others in _partners(members, i, j):
            for b in survivors(sig, a, others).tolist():
                forest.join(a, b)
        out += [(members[x]["key"], members[r]["key"]) for x in range(len(members)) if (r := forest.root(x)) != x]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


LINKS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("class_links", T.LongType()), T.StructField("root", T.BinaryType())])


def _exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member of a block pair: linked rows and classes, and the root of its spanning tree."""
    schema = arrow_schema(LINKS)
    for (_, i, j), members in _groups(batches, ["grp", "i", "j"]):
        n = len(members)
        sets = [np.frombuffer(m["grams"], np.uint64) for m in members]
        sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint16).reshape(n, HASHES)
        size = np.array([len(s) for s in sets])
        copies = np.array([m["copies"] for m in members])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(ids, np.cumsum(size)[:-1])
        held = np.zeros(int(size.sum()) + 1, bool)
        links, linked, forest = np.zeros(n, np.int64), np.zeros(n, np.int64), Forest(n)
        for a, others in _partners(members, i, j):
            # sizes further apart than the threshold can't reach it
            others = others[(size[others] >= THRESHOLD * size[a]) & (size[a] >= THRESHOLD * size[others])]
            others = survivors(sig, a, others)
            if not len(others):
                continue
            held[ids[a]] = True
            both = np.add.reduceat(held[np.concatenate([ids[b] for b in others])], np.concatenate([[0], np.cumsum(size[others])[:-1]]), dtype=np.int64)
            held[ids[a]] = False
            # both / union >= 4/5, in whole numbers
            hit = others[5 * both >= 4 * (size[a] + size[others] - both)]
            links[a] += copies[hit].sum()
            links[hit] += copies[a]
            linked[a] += len(hit)
            linked[hit] += 1
            for b in hit.tolist():
                forest.join(a, b)
        some = np.flatnonzero(linked)
        if len(some):
            keys = [m["key"] for m in members]
            columns = [[keys[x] for x in some], links[some], linked[some], [keys[forest.root(x)] for x in some.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(key, label): the least key that each key of the edges (a, b) reaches. Rounds of least neighbour and pointer jumping, each written."""
    # written first: each reading of a plan may choose other spanning edges, and the two directions must be of the same ones
    half = written(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-half")
    both = written(half.union(half.select("b", "a")).distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label")), f"{name}-labels")
    discard(half)
    old = labels
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, labels["key"] == near["a"]).select("key", F.least("label", "m").alias("new"), "label")
        up = labels.select(F.col("key").alias("new"), F.col("label").alias("top"))
        labels_next = written(new.join(up, "new").select("key", F.least("new", "top").alias("label"), (F.least("new", "top") != F.col("label")).alias("changed")), f"{name}-labels")
        done = not labels_next.filter("changed").limit(1).count()
        discard(old)
        old, labels = labels_next, labels_next.select("key", "label")
        if done:
            discard(both)
            return labels


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key; classes: key, id, copies, n_links, label), by which near-duplicate groups share a label.

    n_links counts the other rows whose text is equal or reaches the threshold.
    """
    ship(docs.sparkSession)
    rows, own = classes(docs)
    with_sets = own.filter("n_shingles > 0")
    banded = with_sets.select("key", F.explode(_bands("sig")).alias("band"))
    # written, so that the joins meet plain exchanges, or a small table, and a band or group that many have is split
    shared = written(banded.groupBy("band").count().filter("count > 1"), "join-shared")
    met = banded.join(shared, "band").join(with_sets.select("key", "sig"), "key").select("band", "count", "key", "sig")
    loose = blocks(met, F.col("count") / BLOCK, ["band"]).select("band", "i", "j", "own", "key", "sig").mapInArrow(_loose, _EDGES)
    groups = components(loose, "join-loose").withColumnRenamed("label", "grp")

    size = written(groups.join(own.select("key", "n_shingles"), "key").groupBy("grp").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")), "join-sizes")
    chosen = groups.join(size, "grp").join(own.select("key", "id", "copies", "sig"), "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), "text")
    texts = texts.join(chosen.select("key", "id"), (texts["key"] == chosen["key"]) & texts["id"].eqNullSafe(chosen["id"]), "left_semi")
    sets = texts.dropDuplicates(["key", "id"]).select("key", _grams_udf("text")["grams"].alias("grams"))
    chunks = F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES)
    dealt = blocks(chosen.join(sets, "key"), chunks, ["grp"]).select("grp", "i", "j", "own", "key", "copies", "sig", "grams")
    found = written(dealt.mapInArrow(_exact, LINKS), "join-found")
    labels = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), "join-exact")
    counted = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    out = own.select("key", "id", "copies").join(counted, "key", "left").join(labels, "key", "left")
    return rows, out.select("key", "id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_links", F.lit(0)).alias("n_class_links"), F.coalesce("label", "key").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: doc_id, class_id, n_links, n_class_links.

    class_id is the least doc_id of the near-duplicate group: texts joined, in one or several steps, by
    equality or by a Jaccard similarity of five-word shingle sets of at least 0.8. Null text counts as
    empty; texts without words equal only each other; a text of fewer than five words is one shingle.
    Rows with a null doc_id take part; a group of only such rows has a null class_id. Rows repeated
    are copies of one another; texts of any length are compared whole. An empty table gives an empty one. Of
    further columns of `docs` none is kept.
    """
    rows, own = links(docs)
    own = written(own, "join-links")
    least = own.groupBy("label").agg(F.min("id").alias("class_id"))
    return rows.join(own.join(least, "label").select("key", "class_id", "n_links", "n_class_links"), "key").select("doc_id", "class_id", "n_links", "n_class_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each near-duplicate group: that of least doc_id (of rows alike in id and text, any one).

    Null text counts as empty, and empty texts are copies of one another; of a group without ids any one stays. Texts
    of any length are compared whole. Columns stay. An empty table gives an empty one.
    """
    _, own = links(docs)
    best = own.groupBy("label").agg(F.min_by(F.struct("key", "id"), F.struct(F.col("id").isNull(), "id", "key")).alias("w")).select(F.col("w.key").alias("k"), F.col("w.id").alias("i"))
    key, at = own_name(docs, "key"), own_name(docs, "id")
    marked = docs.withColumn(key, text_key()).withColumn(at, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")))
    best = best.select(F.col("k").alias(key), F.coalesce(F.col("i").cast("string"), F.lit("null")).alias(at))
    return marked.join(best, [key, at], "left_semi").dropDuplicates([key, at]).drop(key, at)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
