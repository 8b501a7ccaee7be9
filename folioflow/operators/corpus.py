"""What to work on next: sets of papers and their order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.dates import between
from folioflow.operators.ordering import numbered

BATCH = 500


def done_count(state: DataFrame, papers: DataFrame, after: date | None = None, before: date | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """done: papers at `done` in the date range and any of the categories; no categories, or none listed, filters nothing."""
    j = state.filter("stage = 'done'").select("paper_id").join(papers.select("paper_id", "published", "categories"), "paper_id").filter(between(F.col("published"), after, before))
    if categories:
        j = j.filter(F.exists("categories", lambda c: c.isin(*categories)))
    return j.agg(F.count("*").alias("done"))


def cached_not_done(cached: DataFrame, state: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Cached papers that are neither done nor failed for good."""
    failed = diagnostics.filter("error_type = 'PermanentError'")
    return cached.select("paper_id").distinct().join(state.filter("stage = 'done'"), "paper_id", "left_anti").join(failed, "paper_id", "left_anti")


def by_policy(candidates: DataFrame, state: DataFrame, policy: str = "finish_first") -> DataFrame:
    """Candidates under a policy for stranded papers, those begun and not done: alone if there are any, or left out."""
    if policy not in ("finish_first", "ignore"):
        raise ValueError(f"unknown policy: {policy}")
    begun = state.select("paper_id", F.lit(True).alias("begun"))
    j = candidates.join(begun, "paper_id", "left").withColumn("stranded", F.coalesce("begun", F.lit(False))).drop("begun")
    if policy == "ignore":
        return j.filter("NOT stranded").drop("stranded")
    some = j.agg(F.coalesce(F.max("stranded"), F.lit(False)).alias("some"))
    return j.crossJoin(F.broadcast(some)).filter(F.col("stranded") == F.col("some")).drop("stranded", "some")


def by_relevance(candidates: DataFrame, ranking: DataFrame, most: int = BATCH) -> DataFrame:
    """The first candidates: ranked ones by rank, then the others by id."""
    return candidates.join(ranking, "paper_id", "left").orderBy(F.asc_nulls_last("rank"), "paper_id").limit(most)


def shards(refs: DataFrame, n: int, order: str = "paper_id") -> DataFrame:
    """`refs` with shard: dealt round in order, as list[i::n] would."""
    return numbered(refs, order, "__place").withColumn("shard", (F.col("__place") % n).cast("int")).drop("__place")


def prefetch_list(refs: DataFrame, handled: DataFrame, cached: DataFrame, skipped: DataFrame) -> DataFrame:
    for other in (handled, cached, skipped):
        refs = refs.join(other.select("paper_id"), "paper_id", "left_anti")
    return refs
