"""Ranks and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 60
#: Stretches of a score's unit that a whole list is ordered in.
STEPS = 32

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def keep_partial_limits(spark: SparkSession, most: int) -> None:
    """Let each task cut every list to its own first `most` rows before they move; beyond this setting Spark moves and sorts them all in one task a list."""
    if int(spark.conf.get(GROUP_LIMIT)) < most:
        spark.conf.set(GROUP_LIMIT, str(most))


def ranked(scored: DataFrame, by: Sequence[str] = (), most: int | None = None, score: str = "score", identifier: str = "id") -> DataFrame:
    """`scored` with a 1-based rank by score descending, then id; the first `most` of each `by`."""
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(F.desc(score), F.asc(identifier))
    if most is not None and not by:
        # one list: each task keeps its own first rows, so the window sees `most` at most
        scored = scored.orderBy(F.desc(score), F.asc(identifier)).limit(most)
    if most is not None and by:
        keep_partial_limits(scored.sparkSession, most)
    if most is None and by:
        return _placed(scored, by, score, identifier)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if most is None else out.filter(F.col("rank") <= most)


def _placed(scored: DataFrame, by: Sequence[str], score: str, identifier: str) -> DataFrame:
    """Ranks of all rows of long lists: each stretch of scores is ordered by itself and moved up by the rows of the stretches above, so no task orders a whole list."""
    keys = [*by, "__step"]
    own = scored.withColumn("__step", F.coalesce(F.rint(F.col(score) * STEPS), F.lit(float("-inf")))).withColumn("__own", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(identifier))))
    above = Window.partitionBy(*by).orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    starts = own.groupBy(*keys).agg(F.max("__own").alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__start"))
    return own.join(starts, keys).select(*scored.columns, (F.col("__own") + F.col("__start")).cast("int").alias("rank"))


def check_fusion(weight: float, k: int) -> None:
    if not 0.0 <= weight <= 1.0:
        raise ValueError("the dense weight lies in [0, 1]")
    if k <= 0:
        raise ValueError("k is positive")


def rrf(dense: DataFrame, sparse: DataFrame, weight: float = 0.5, k: int = K, by: Sequence[str] = ()) -> DataFrame:
    """Weighted reciprocal rank fusion of two lists (by..., id, rank): every id of either, a missing side adding nothing.

    An id twice in a list is an error.
    """
    check_fusion(weight, k)
    keys = [*by, "id"]

    def one(df: DataFrame, name: str) -> DataFrame:
        best = df.groupBy(*keys).agg(F.max("rank").alias(name), F.count("*").alias("n"))
        return best.select(*keys, F.when(F.col("n") > 1, F.raise_error(F.lit(f"an id is twice in the {name} list")).cast("int")).otherwise(F.col(name)).alias(name))

    both = one(dense, "dense").join(one(sparse, "sparse"), keys, "full_outer")
    part: Column = F.coalesce(F.lit(weight) / (k + F.col("dense")), F.lit(0.0)) + F.coalesce(F.lit(1.0 - weight) / (k + F.col("sparse")), F.lit(0.0))
    return both.select(*keys, part.alias("score"))
