"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams are hashed to buckets, each with a learned vector;
an n-gram is of code points and lies within a word and the marks at its ends.
A document is the mean of its features' vectors; a softmax over its product with an output matrix gives
the class. Both are learned by stochastic gradient descent in numpy on a bounded sample of labelled
documents. For scoring, each bucket's vector is folded into its difference of logits, so that a whole
text costs one look-up a feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import documents, fold, ship, text_udf
from folioflow.llm.text import mix, word_hashes

#: Labelled documents to learn from, at most: those of least hash of their id.
MAX_TRAIN = 4000
BUCKETS, DIM = 1 << 17, 16
GRAMS = (2, 3, 4)
#: Stands for a word's ends.
MARK = 0x20
#: Steps of the descent, over as many epochs as that takes.
STEPS, RATE, SEED = 24_000, 0.5, 12
THRESHOLD = 0.3
HELD_OUT = 5


def _word_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, then of pairs of neighbours; the exclusive or of a pair sends every repeated word to one bucket."""
    h, first = word_hashes(buf, offsets)
    pair = mix((h[1:] ^ h[:-1]) + np.uint64(1)) if len(h) > 1 else np.zeros(0, np.uint64)
    return np.concatenate([h, pair]) % np.uint64(BUCKETS), first


class _Characters:
    """Code points of some texts, each word between marks, and the n-grams that cross none."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
        first = lead[offsets]
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        # a mark before every text and after the last
        self.points = np.insert(np.where(blank, np.uint32(MARK), points), first, np.uint32(MARK))
        self.marks = np.zeros(len(self.points) + 1, np.int64)
        np.cumsum(np.insert(blank, first, True), out=self.marks[1:])
        self.begin = first + np.arange(len(first))

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams, and for each text the index of its first (one more at the end)."""
        m = len(self.points) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint32), np.zeros(len(self.begin), np.int64)
        inside = self.marks[n - 1 : n - 1 + m] - self.marks[1 : 1 + m] if n > 2 else np.where(self.marks[2 : 2 + m] - self.marks[:m] == 2, 1, 0)
        at = np.flatnonzero(inside == 0)
        h = np.full(len(at), n * 0x9E37, np.uint32)
        for k in range(n):
            h = (h ^ self.points[at + k]) * np.uint32(0x01000193)
        return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(15)) % np.uint32(BUCKETS), np.searchsorted(at, self.begin)


def _spans(buf: np.ndarray, offsets: np.ndarray):
    """(buckets, first, one after last for each text) of each kind of feature."""
    ids, first = _word_buckets(buf, offsets)
    n = int(first[-1])
    yield ids[:n], first[:-1], first[1:]
    yield ids[n:], first[:-1], np.maximum(first[1:] - 1, first[:-1])
    characters = _Characters(buf, offsets)
    for g in GRAMS:
        ids, first = characters.buckets(g)
        yield ids, first[:-1], first[1:]


SHARES = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("shares", T.ArrayType(T.FloatType()))])


def features(buf: np.ndarray, offsets: np.ndarray) -> list[list[np.ndarray]]:
    """Buckets of each text, ascending, and the share of its features in each: BUCKETS numbers of a text at most."""
    spans = list(_spans(buf, offsets))
    found, shares = [], []
    for i in range(len(offsets) - 1):
        ids, n = np.unique(np.concatenate([b[int(a[i]) : int(z[i])].astype(np.int64) for b, a, z in spans]), return_counts=True)
        found.append(ids)
        shares.append((n / max(1, n.sum())).astype(np.float32))
    return [found, shares]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> tuple[np.ndarray, float]:
    """(difference of logits of each bucket, bias) from the features of texts."""
    rng = np.random.default_rng(SEED)
    vectors = ((rng.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM).astype(np.float32)
    output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    epochs = -(-STEPS // len(rows))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = rows[i]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ output
            output -= rate * np.outer(p, hidden)
            bias -= rate * 0.1 * p
            if len(ids):
                vectors[ids] -= rate * len(ids) ** 0.5 * share[:, None] * back
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


_features_udf = text_udf(features, SHARES)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, ids, shares, quality of the sample: labels whose fold isn't held out, at most MAX_TRAIN, one a document; of rows of one id the text that sorts first."""
    ids = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", HELD_OUT) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    # MAX_TRAIN rows of two numbers: small enough for any executor
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    return sample.select("doc_id", "quality", _features_udf("text").alias("f")).select("doc_id", "quality", "f.*")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model; without labelled rows one that scores every text 0.5."""
    ship(docs.sparkSession)
    # features are made where the texts are: BUCKETS numbers of MAX_TRAIN rows come here at most
    rows = training_rows(docs, labels).orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    each = [(np.asarray(i.values), np.asarray(x.values)) for i, x in zip(rows["ids"], rows["shares"], strict=True)]
    return fit(each, [int(q) for q in rows["quality"].to_pylist()])


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 of each whole text, of any length. A null or empty text gets the bias alone.

    Rows repeated are scored alike; a column of that name is replaced, others pass through; an empty table gives
    an empty one. Ties in the sample's order go by id.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # BUCKETS numbers

    def work(buf: np.ndarray, offsets: np.ndarray) -> list:
        weights, bias = sent.value
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for ids, a, z in _spans(buf, offsets):
            run = np.zeros(len(ids) + 1)
            np.cumsum(weights[ids], out=run[1:], dtype=np.float64)
            has = z > a
            total[has] += run[z[has]] - run[a[has]]
            count += z - a
        return [1 / (1 + np.exp(-np.clip(bias + total / np.maximum(count, 1), -30, 30)))]

    return docs.withColumn(name, text_udf(work, T.StructType([T.StructField("score", T.DoubleType())]))("text")["score"])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
