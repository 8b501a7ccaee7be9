"""Retrieval quality: ranks of gold results, recall and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_ranks(questions: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """question_id, question_type, paper_rank, passage_rank, passage_scored of all questions.

    questions: question_id, question_type, gold_paper_ids, gold_block_id; results: question_id, rank, paper_id,
    block_id. Misses have null ranks; questions without results, failed ones too, stay.
    """
    r = results.filter(F.col("rank") <= k)
    j = questions.join(r, "question_id", "left")
    paper = F.min(F.when(F.array_contains("gold_paper_ids", F.col("paper_id")), F.col("rank")))
    passage = F.min(F.when(F.col("block_id") == F.col("gold_block_id"), F.col("rank")))
    return j.groupBy("question_id", "question_type").agg(paper.alias("paper_rank"), passage.alias("passage_rank"), F.max(F.col("gold_block_id").isNotNull()).alias("passage_scored"))


def recall_mrr(ranks: DataFrame, column: str = "paper_rank") -> DataFrame:
    """question_type (null: all), n, recall, mrr in one pass by grouping sets; null figures where there is no question."""
    view = ranks.groupingSets([[], [F.col("question_type")]], F.col("question_type"))
    hit = F.col(column).isNotNull().cast("double")
    return view.agg(F.grouping("question_type").alias("overall"), F.count("*").alias("n"), F.avg(hit).alias("recall"), (F.sum(F.coalesce(1.0 / F.col(column), F.lit(0.0))) / F.count("*")).alias("mrr"))


def report(ranks: DataFrame) -> DataFrame:
    """level, question_type, overall, n, recall, mrr for papers, and for passages of the questions that have one."""
    paper = recall_mrr(ranks, "paper_rank").withColumn("level", F.lit("paper"))
    passage = recall_mrr(ranks.filter("passage_scored"), "passage_rank").withColumn("level", F.lit("passage"))
    return paper.unionByName(passage)


def questions(truth: DataFrame, blind: DataFrame) -> DataFrame:
    """Ground truth with question texts: where any has none of its own, the blind table's text goes first; none at all is an error."""
    some = truth.agg(F.coalesce(F.max(F.col("question_text").isNull()), F.lit(False)).alias("lacking"))
    j = truth.join(blind.select("question_id", F.col("question_text").alias("blind_text")), "question_id", "left").crossJoin(F.broadcast(some))
    text = F.when(F.col("lacking"), F.coalesce("blind_text", "question_text")).otherwise(F.col("question_text"))
    gold = F.array_distinct(F.concat(F.array("source_paper_id"), F.coalesce("additional_gold_paper_ids", F.array().cast("array<string>"))))
    return j.withColumn("text", F.when(text.isNull(), F.raise_error(F.lit("a question has no text")).cast("string")).otherwise(text)).withColumn("gold_paper_ids", gold).drop("blind_text", "lacking", "question_text")


def arms(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Two tables of the same ids in one, told apart by `arm`."""
    return base.withColumn("arm", F.lit("base")).unionByName(variant.withColumn("arm", F.lit("variant")))


#: Words of an anchor, and items that are named in the plan, at most.
ANCHOR, MOST_NAMED = 3, 1000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def holders(items: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, paper_id: which documents (paper_id, text) hold the whole text of which items (item_id, item).

    The words of an item but its first and last stand in a document as they are, so ANCHOR of them in a row bring the two together by an equal
    join, and only such pairs are looked at. Items of fewer words are held against every document. An empty item is in every document, a null one in none.
    """
    w = _words(F.col("item"))
    keyed = items.filter("item IS NOT NULL").select("item_id", "item", F.when(F.size(w) >= ANCHOR + 2, F.xxhash64(F.slice(w, 2, ANCHOR))).alias("anchor"))
    long, short = keyed.filter("anchor IS NOT NULL"), keyed.filter("anchor IS NULL").drop("anchor")
    d = documents.filter("text IS NOT NULL").select("paper_id", "text", _words(F.col("text")).alias("words"))
    places = F.sequence(F.lit(1), F.size("words") - (ANCHOR - 1))
    anchors = F.when(F.size("words") >= ANCHOR, F.transform(places, lambda at: F.xxhash64(F.slice("words", at, F.lit(ANCHOR))))).otherwise(F.array().cast("array<bigint>"))
    named = long.select("anchor").distinct().limit(MOST_NAMED + 1).collect()
    if len(named) <= MOST_NAMED:
        anchors = F.filter(anchors, lambda a: a.isin([r.anchor for r in named]))
    met = d.select("paper_id", "text", F.explode(F.array_distinct(anchors)).alias("anchor")).join(long, "anchor")
    both = met.filter(F.contains("text", "item")).select("item_id", "paper_id")
    # few words, so few items: a stated set of texts against all documents
    rest = documents.filter("text IS NOT NULL").join(F.broadcast(short) if short.limit(MOST_NAMED + 1).count() <= MOST_NAMED else short, F.contains("text", "item")).select("item_id", "paper_id")
    return both.unionByName(rest)
