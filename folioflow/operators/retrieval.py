"""From ranked ids to cited results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K, MOST_K, POOL = 10, 100, 32
#: Results join as broadcasts while there are at most so many.
MOST_HITS = 10_000


def clamp_k(k: int | None) -> int:
    return DEFAULT_K if k is None else max(1, min(k, MOST_K))


def pool_size(k: int, depth: int = POOL) -> int:
    return max(k, min(depth, POOL))


def reranked(hits: DataFrame, scores: Column | None = None, depth: int = POOL) -> DataFrame:
    """The first `depth` hits of each query in a new order: by `scores` descending, ties by the rank they had.

    Without scores the order is turned round, a stand-in that can't be mistaken for doing nothing. The
    column score stays the fused one.
    """
    first = hits.filter(F.col("rank") <= depth)
    by = [F.desc("rank")] if scores is None else [F.desc(scores), F.asc("rank")]
    return first.withColumnRenamed("rank", "pool_rank").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*[F.desc("pool_rank")] if scores is None else [by[0], F.asc("pool_rank")])))


def citation(url_id: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), url_id)


def few(hits: DataFrame, bound: int | None) -> DataFrame:
    """`hits`, sent to every task if they are known to be MOST_HITS at most: nothing that they join then moves."""
    return hits if bound is None or bound > MOST_HITS else F.broadcast(hits)


def grounded(hits: DataFrame, chunks: DataFrame, papers: DataFrame, blocks: DataFrame, k: int, bound: int | None = None) -> DataFrame:
    """Hits (query_id, id, score, rank) joined to their chunk, paper and anchor block; the first k of each query.

    `bound`: how many hits there are at most, where the caller knows. Hits without a chunk or paper drop out before the cut to k; a chunk whose block is missing is an error. The
    section is the block's own.
    """
    hits = few(hits, bound)
    j = chunks.join(hits, hits["id"] == chunks["chunk_id"])
    # a hit meets one chunk: what was few stays few
    j = papers.join(few(j, bound), "paper_id")
    b = blocks.select("block_id", F.col("section_path").alias("block_section"), F.lit(True).alias("stored"))
    if bound is not None and bound <= MOST_HITS:
        b = b.join(F.broadcast(j.select("block_id").distinct()), "block_id", "left_semi")
    j = j.join(b, "block_id", "left")
    section = F.when(F.col("stored").isNull(), F.raise_error(F.lit("a chunk's block is missing")).cast("string")).otherwise(F.col("block_section"))
    j = j.select("query_id", "id", "score", "rank", "paper_id", "title", "block_id", "text", section.alias("section_path"), citation(F.col("paper_id")).alias("url"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return j.withColumn("place", place).filter(F.col("place") <= k)


def orphans(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose chunk is gone."""
    return hits.join(chunks, hits["id"] == chunks["chunk_id"], "left_anti")


def paper_results(hits: DataFrame, summaries: DataFrame, papers: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """Hits on summaries joined to their paper and its sections in reading order; the first k of each query."""
    paper = F.regexp_replace(F.col("id"), ":summary$", "")
    j = hits.withColumn("paper_id", paper).join(summaries.select("paper_id", F.col("text").alias("summary")), "paper_id").join(papers, "paper_id").join(sections, "paper_id", "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return j.withColumn("place", place).filter(F.col("place") <= k).withColumn("url", citation(F.col("paper_id")))


def sections_of(blocks: DataFrame) -> DataFrame:
    """paper_id, sections: different section paths in reading order."""
    first = blocks.groupBy("paper_id", "section_path").agg(F.min("idx").alias("at"))
    return first.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "section_path"))), lambda s: s["section_path"]).alias("sections"))


def coverage(pool: DataFrame, returned: DataFrame) -> DataFrame:
    """query_id, returned, candidates: rows given back and rows of the pool before reranking."""
    n = pool.groupBy("query_id").agg(F.count("*").alias("candidates"))
    m = returned.groupBy("query_id").agg(F.count("*").alias("returned"))
    return n.join(m, "query_id", "left").select("query_id", F.coalesce("returned", F.lit(0)).cast("long").alias("returned"), "candidates")


def span(blocks: DataFrame, block_id: str) -> DataFrame:
    """The whole text of an anchor's block."""
    return blocks.filter(F.col("block_id") == block_id).select("block_id", "text")


def relevance(summary_vectors: DataFrame, topic: DataFrame) -> DataFrame:
    """id, relevance_score: cosine of each summary's vector (id, embedding) with the one topic vector."""
    from folioflow.functions.vectors import cosine

    return summary_vectors.crossJoin(F.broadcast(topic.limit(1).select("vector"))).select("id", cosine(F.col("embedding"), F.col("vector")).alias("relevance_score"))
