"""Pipeline state: stages, checkpoints, dead letters, upserts, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages in order.
STAGES = ("harvested", "parsed", "chunked", "summarized", "embedded", "stored", "done")


def stage_order(stage: Column) -> Column:
    """Place of a stage; an error for an unknown one."""
    out = F.raise_error(F.concat(F.lit("unknown stage: "), F.coalesce(stage, F.lit("null")))).cast("int")
    for i, s in reversed(list(enumerate(STAGES))):
        out = F.when(stage == s, F.lit(i)).otherwise(out)
    return out


def at_least(stage: Column, target: str) -> Column:
    return stage_order(stage) >= STAGES.index(target)


def worklist(refs: DataFrame, state: DataFrame, target: str = "done") -> DataFrame:
    """`refs` not yet at the target, with the stage to resume from (null: never begun)."""
    j = refs.join(state.select("paper_id", "stage"), "paper_id", "left")
    return j.filter(F.col("stage").isNull() | ~at_least(F.col("stage"), target))


def merged_checkpoints(old: DataFrame, new: DataFrame, artifacts: list[str]) -> DataFrame:
    """Full outer merge by paper: the new stage, each artifact new or else old; `done` clears the artifacts."""
    j = old.alias("o").join(new.alias("n"), "paper_id", "full_outer")
    stage = F.coalesce("n.stage", "o.stage")
    return j.select("paper_id", stage.alias("stage"), *[F.when(stage != "done", F.coalesce(f"n.{a}", f"o.{a}")).alias(a) for a in artifacts])


def quarantined(failures: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row a paper, the first reason (by ts, then error) wins; papers in quarantine already stay as they are."""
    w = Window.partitionBy("paper_id").orderBy("ts", "error")
    first = failures.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return first if existing is None else existing.unionByName(first.join(existing, "paper_id", "left_anti"))


def upserted(table: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """The table with all rows of the new keys replaced. Write it to another path, then swap."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def last_write(table: DataFrame, key: str, order: str) -> DataFrame:
    return table.groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns if c != key]), order).alias("__v")).select(key, "__v.*")


def cascade_ids(chunks: DataFrame, summaries: DataFrame, papers: DataFrame) -> DataFrame:
    """id: chunks and summaries that go with the papers to delete; parents may be gone already."""
    c = chunks.join(papers, "paper_id", "left_semi").select(F.col("chunk_id").alias("id"))
    s = summaries.join(papers, "paper_id", "left_semi").select(F.col("summary_id").alias("id"))
    return c.unionByName(s)


def funnel(state: DataFrame) -> DataFrame:
    """stage, ord, reached: papers at the stage or beyond, every stage listed."""
    spark = state.sparkSession
    every = spark.createDataFrame(list(enumerate(STAGES)), "ord int, stage string")
    n = every.join(state.groupBy("stage").agg(F.count("*").alias("n")), "stage", "left")
    # seven rows: one partition is enough
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    return n.select("stage", "ord", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("reached"))


def unrecovered(quarantine: DataFrame, state: DataFrame) -> DataFrame:
    return quarantine.join(state.filter("stage = 'done'"), "paper_id", "left_anti")


def quarantine_reasons(quarantine: DataFrame, diagnostics: DataFrame, state: DataFrame) -> DataFrame:
    """reason, n: papers in quarantine and not done by error type, and a last bucket for those without diagnostics."""
    known = unrecovered(diagnostics, state).groupBy(F.col("error_type").alias("reason")).agg(F.count("*").alias("n"))
    total = unrecovered(quarantine, state).agg(F.count("*").alias("t"))
    rest = total.crossJoin(known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("d"))).filter("t > d").select(F.lit("unknown (quarantined before diagnostics were recorded)").alias("reason"), (F.col("t") - F.col("d")).alias("n"))
    return known.unionByName(rest)


def incomplete(state: DataFrame, papers: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """paper_id, n_chunks, n_blocks of done papers that lack either."""
    count = lambda df, name: df.groupBy("paper_id").agg(F.count("*").alias(name))
    done = state.filter("stage = 'done'").select("paper_id").join(papers.select("paper_id"), "paper_id")
    j = done.join(count(chunks, "n_chunks"), "paper_id", "left").join(count(blocks, "n_blocks"), "paper_id", "left").na.fill(0, ["n_chunks", "n_blocks"])
    return j.filter("n_chunks = 0 OR n_blocks = 0")


def known_ids(state: DataFrame, quarantine: DataFrame) -> DataFrame:
    return state.select("paper_id").union(quarantine.select("paper_id")).distinct()
