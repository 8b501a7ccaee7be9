"""Filters and the two channels of a hybrid search.

A collection has id, kind, text, categories, published and embedding. Questions may come in numbers:
they are one table keyed by query_id, and every step works on all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.dates import between
from folioflow.functions.text import tokens
from folioflow.operators import vector_index
from folioflow.operators.fusion import ranked, rrf

#: Questions that count as few: they are sent to every task.
MOST_QUESTIONS = 1000


@dataclass(frozen=True)
class Filters:
    """categories: any of them; an empty list admits nothing. Dates include both ends."""

    categories: tuple[str, ...] | None = None
    published_after: date | None = None
    published_before: date | None = None
    kind: str | None = None


def filtered(collection: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Below any ranking, so that it reaches the scan."""
    out = collection.filter(between(F.col("published"), filters.published_after, filters.published_before))
    if filters.kind is not None:
        out = out.filter(F.col("kind") == filters.kind)
    if filters.categories is not None:
        out = out.filter(F.arrays_overlap("categories", F.array(*map(F.lit, filters.categories)).cast("array<string>")))
    return out


def dense(collection: DataFrame, questions: DataFrame, most: int | None = None, undefined: bool = False) -> DataFrame:
    """query_id, id, score, rank: the `most` rows (all without it) of highest cosine with each question (query_id, vector), 0 for a zero vector; a row without a vector has no score.

    `undefined`, for whole lists: a zero vector's score is NaN, above all others, and a row without a vector comes last, as SQL has it.
    """
    return ranked(vector_index.scores(collection, questions, most, undefined=undefined), ["query_id"], most)


def term_counts(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, token, tf: how often each word of the text, in lower case, occurs."""
    return rows.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def document_frequencies(terms: DataFrame, documents: DataFrame) -> DataFrame:
    """token, df, idf: ln((N - df + 0.5) / (df + 0.5) + 1), N all documents."""
    n = documents.agg(F.count("*").alias("n"))
    return terms.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def overlap_scores(collection: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, id, score: how many different words a row shares with each question (query_id, text); none, no row."""
    wanted = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    rows = collection.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return rows.join(wanted, "token").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))


def kept_terms(collection: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """id, token, tf and what `filtered` reads: written once, in order of token, a search reads the parts with its own words alone."""
    carried = ["kind", "categories", "published", *also]
    terms = collection.select("id", *carried, F.explode(tokens(F.col("text"))).alias("token"))
    return terms.groupBy("id", "token").agg(F.count("*").alias("tf"), *[F.first(c).alias(c) for c in carried])


def tfidf_scores(collection: DataFrame, questions: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """query_id, id, score: sum over shared words of tf * tf in the question * idf. Frequencies are those of `everything`."""
    everything = collection if everything is None else everything
    terms = term_counts(collection)
    return term_scores(terms, terms if everything is collection else term_counts(everything), questions, everything)


def term_scores(terms: DataFrame, every: DataFrame, questions: DataFrame, everything: DataFrame) -> DataFrame:
    """`tfidf_scores` from counted words: `terms` of the rows to search, `every` of `everything`."""
    asked = term_counts(questions, "query_id").withColumnRenamed("tf", "asked")
    # only words that are asked for need a frequency
    known = document_frequencies(every.join(asked.select("token").distinct(), "token", "left_semi"), everything)
    hits = terms.join(asked.join(known, "token"), "token")
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("tf") * F.col("asked") * F.col("idf")), 9).alias("score"))


def sparse(scores: DataFrame, most: int | None = None) -> DataFrame:
    return ranked(scores.filter("score > 0"), ["query_id"], most)


def hybrid(collection: DataFrame, questions: DataFrame, filters: Filters = Filters(), weight: float = 0.5, most: int = 10, channel: str = "tfidf", terms: DataFrame | None = None, undefined: bool = False) -> DataFrame:
    """query_id, id, score, rank: the `most` best of each question (query_id, vector, text) by both channels fused, each channel with all its rows.

    `terms`: `kept_terms` of the whole collection, or those of all words of the questions, so that no text is taken apart. `undefined`: as in `dense`.
    """
    rows = filtered(collection, filters)
    if channel != "tfidf":
        scores = overlap_scores(rows, questions)
    elif terms is None:
        scores = tfidf_scores(rows, questions, collection)
    else:
        scores = term_scores(filtered(terms, filters).select("id", "token", "tf"), terms.select("id", "token"), questions, collection)
    fused = rrf(dense(rows, questions, undefined=undefined), sparse(scores), weight, by=["query_id"])
    return ranked(fused.withColumn("score", F.round("score", 12)), ["query_id"], most)


def request_filters(categories: str | None = None, after: str | None = None, before: str | None = None) -> Filters:
    """Filters of a request's texts: a comma list, ISO dates. What can't be read doesn't filter; a reversed range is an error."""
    from folioflow.functions.dates import compact_date

    def day(text: str | None) -> date | None:
        try:
            return compact_date(text)
        except ValueError:
            return None

    lo, hi = day(after), day(before)
    if lo and hi and lo > hi:
        raise ValueError("the range of dates is reversed")
    return Filters(tuple(c.strip() for c in (categories or "").split(",") if c.strip()) or None, lo, hi)
