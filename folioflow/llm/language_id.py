"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word falls back to its longest
character n-grams that are known: length five, then four, down to single letters. A text's score is
the sum over its words; its language the best one. A word is a run of letters, the Unicode category L,
in lower case, when learning and when scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import arrow_schema, discard, documents, fold, ship, text_udf, written

#: Labelled documents to learn from, at most, shared evenly by the languages: those of least hash of their id. All their words are learned.
MAX_TRAIN = 12_000
LONGEST = 5
#: An n-gram is known that the sample's words have so often.
LEAST_SEEN = 4
#: A language at most so many nats behind the best one for a word.
WORST = 8.0
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2

#: Runs of letters and of numbers that aren't digits; `words_of` takes the latter out.
_RUNS = re.compile(r"[^\W\d_]+")
#: Words and their vectors that a worker keeps at once; it starts anew beyond.
MEMO = 300_000


def words_of(text: str) -> Counter[str]:
    """How often each word of a text occurs."""
    found = Counter(_RUNS.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def training_rows(docs: DataFrame, usable: Column) -> DataFrame:
    """lang, text of the sample.

    Ids whose hash is below a share of all, taken from a sketch of their number and somewhat too large, are ranked; the
    others aren't moved. Of rows with one id and language one text is taken.
    """
    named = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & usable)
    sizes = written(named.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("about")), "language-sizes")
    each = max(1, MAX_TRAIN // max(1, sizes.count()))
    share = F.lit(1.3 * each + 20 * each**0.5 + 50) / F.col("about")
    few = named.select("lang", "doc_id").join(sizes, "lang").filter(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= share).select("lang", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = few.withColumn("r", rank).filter(F.col("r") <= each).orderBy("r", "lang").limit(MAX_TRAIN).select("lang", "doc_id")
    # at most MAX_TRAIN rows of an id and a name
    return named.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


_GRAMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])


def _gram_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each n-gram occurs in a batch of words (lang, key, n), single letters without the word's ends. Time grows with a word's length alone, however long it is."""
    schema = arrow_schema(_GRAMS)
    for batch in batches:
        found: Counter[tuple[str, str]] = Counter()
        for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "key", "n")), strict=True):
            padded = f" {word} "
            for size in range(1, LONGEST + 1):
                source = word if size == 1 else padded
                for i in range(len(source) - size + 1):
                    found[lang, source[i : i + size]] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)


def counts(sample: DataFrame) -> dict[str, pa.Table]:
    """Tables of (key, list of language and count): all words of the sample, and its n-grams by length."""
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("key")
    n = written(sample.select("lang", word).filter("key <> ''").groupBy("lang", "key").agg(F.count("*").alias("n")), "language-words")
    by_gram = n.mapInArrow(_gram_rows, _GRAMS).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    gathered = lambda df: df.groupBy("key").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    # of a sample of MAX_TRAIN texts
    out = {"words": gathered(n).select("key", "by_lang").orderBy("key").toArrow(), "grams": gathered(by_gram).filter(F.col("total") >= LEAST_SEEN).select("key", "by_lang").orderBy("key").toArrow()}
    discard(n)
    return out


class Model:
    """Log frequencies of words and n-grams in each language, as losses against the best language, from 0 to -WORST."""

    def __init__(self, tables: dict[str, pa.Table]):
        names = [t["by_lang"].combine_chunks().flatten().field("lang") if t.num_rows else pa.array([], pa.string()) for t in tables.values()]
        self.langs = sorted(set().union(*(set(x.unique().to_pylist()) for x in names)))
        self.words = self._losses(tables["words"])
        size = np.array([len(k) for k in tables["grams"]["key"].to_pylist()], np.int64)
        self.grams = [self._losses(tables["grams"].filter(pa.array(size == k))) for k in range(1, LONGEST + 1)]

    def _losses(self, table: pa.Table) -> tuple[dict[str, int], np.ndarray]:
        """Row of each key, and the rows."""
        if not table.num_rows:
            return {}, np.zeros((0, 0), np.float32)
        lists = table["by_lang"].combine_chunks()
        n = np.zeros((table.num_rows, len(self.langs)), np.float32)
        place = {k: i for i, k in enumerate(self.langs)}
        column = np.array([place[k] for k in lists.flatten().field("lang").to_pylist()])
        n[lists.value_parent_indices().to_numpy(), column] = lists.flatten().field("n").to_numpy()
        log = np.log(n + 0.2) - np.log(n.sum(axis=0) + 0.2 * len(n))
        return {k: i for i, k in enumerate(table["key"].to_pylist())}, np.maximum(log - log.max(axis=1, keepdims=True), -WORST).astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        rows, losses = self.words
        known = rows.get(word)
        if known is not None:
            return losses[known]
        padded = f" {word} "
        for size in range(LONGEST, 0, -1):
            source, (rows, losses) = word if size == 1 else padded, self.grams[size - 1]
            found = [i for at in range(len(source) - size + 1) if (i := rows.get(source[at : at + size])) is not None]
            if found:
                return losses[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """A model with the vectors of words met of late."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((MEMO, len(self.model.langs)), np.float32)

    def of(self, text: str) -> tuple[str, float]:
        found = words_of(text)
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.langs))
        words, counts = list(found), np.fromiter(found.values(), np.float64, len(found))
        for at in range(0, len(words), MEMO // 2):
            part = words[at : at + MEMO // 2]
            if len(self.index) + len(part) > MEMO:
                self.clear()
            index, ids = self.index, []
            for w in part:
                i = index.get(w)
                if i is None:
                    i = index[w] = len(index)
                    self.rows[i] = self.model.word(w)
                ids.append(i)
            total += counts[at : at + len(part)] @ self.rows[ids]
        best = int(np.argmax(total))
        return self.model.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700.0)).sum())


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def train(docs: DataFrame, usable: Column | None = None) -> Model:
    """Learned from the text and lang of the sample alone. `usable`: which rows may be learned from."""
    return Model(counts(training_rows(docs, F.lit(True) if usable is None else usable)))


def with_language(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """`docs` with a struct of lang_pred and score, the chosen language's share of the likelihood, of each whole text.

    A null text, or one without a letter, is `und` with score 0; so is any text where nothing was learned.
    Ties go to the first language by name. Rows repeated are scored alike; texts of any length are scored whole;
    a column of that name is replaced, others pass through; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # words and n-grams of MAX_TRAIN texts
    held: list[Scorer] = []

    def work(buf: np.ndarray, offsets: np.ndarray) -> list:
        if not held:
            held.append(Scorer(sent.value))
        raw = buf.tobytes()
        out = [held[0].of(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return [[x for x, _ in out], [x for _, x in out]]

    return docs.withColumn(name, text_udf(work, PREDICTED)("text"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, fold("doc_id", FOLDS) != HELD_OUT)
    said = with_language(docs.select("doc_id", "text"), model)
    return said.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")
