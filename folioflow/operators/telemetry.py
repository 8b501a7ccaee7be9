"""Runs as data: samples, events, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.dates import eta_s, per_hour

HIGH_UTIL = 90


def gpu_by_stage(samples: DataFrame) -> DataFrame:
    """Samples (stage, util, mem, power) by stage; power is averaged over those that have it."""
    return samples.groupBy("stage").agg(
        F.avg("util").alias("mean_util"), (F.avg((F.col("util") >= HIGH_UTIL).cast("double")) * 100.0).alias("pct_high"), F.max("mem").alias("peak_mem"), F.avg("power").alias("mean_power"), F.count("*").alias("n")
    )


def benchmark_stats(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs (config, total_pages, elapsed_s, oom) with figures of their samples (config, util, mem); all zero if out of memory or without samples."""
    s = samples.groupBy("config").agg(F.avg("util").alias("u"), F.avg((F.col("util") == 0).cast("double")).alias("z"), F.avg((F.col("util") >= HIGH_UTIL).cast("double")).alias("h"), F.max("mem").alias("m"), F.count("*").alias("c"))
    j = runs.join(s, "config", "left")
    ok = lambda x: F.when(F.col("oom"), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))
    rate = F.when(F.col("oom") | (F.col("elapsed_s") <= 0), 0.0).otherwise(F.col("total_pages") / (F.col("elapsed_s") / 60.0))
    return j.select("config", "total_pages", "elapsed_s", "oom", ok(F.col("u")).alias("avg_util"), ok(F.col("z") * 100.0).alias("pct_zero"), ok(F.col("h") * 100.0).alias("pct_high"), ok(F.col("m").cast("double")).alias("peak_mem"), rate.alias("pages_per_minute"), F.coalesce("c", F.lit(0)).cast("long").alias("n_samples"))


def latest_run(events: DataFrame, line: str = "line_no") -> DataFrame:
    """The events of the run that wrote the last line."""
    last = events.agg(F.max_by("run_id", line).alias("run_id"))
    return events.join(F.broadcast(last), "run_id")


def current_stage(events: DataFrame, line: str = "line_no", by: str = "run_id") -> DataFrame:
    """by, stage. A start names the stage, its own end clears it, the run's end sets `done`.

    What was set last counts, unless an end of the same name came after it; two aggregates of a row a stage tell that,
    however long the log is.
    """
    order = F.struct(line, "event", "stage")
    ends = F.col("event") == "STAGE_END"
    steps = events.filter(F.col("event").isin("STAGE_START", "STAGE_END", "RUN_END"))
    steps = steps.withColumn("__name", F.when(F.col("event") == "RUN_END", "done").otherwise(F.col("stage")))
    last = steps.groupBy(by, "__name").agg(F.max(F.when(~ends, order)).alias("__set"), F.max(F.when(ends, order)).alias("__end"))
    open_ = F.when(F.col("__end").isNull() | (F.col("__end") < F.col("__set")), F.col("__name"))
    return last.groupBy(by).agg(F.max_by(open_, "__set").alias("stage"))


def wall_clock(events: DataFrame, now: Column, line: str = "line_no") -> DataFrame:
    """run_id, seconds: of the first RUN_END, else since the first RUN_START; null without a start."""
    start = F.min_by("ts", F.when(F.col("event") == "RUN_START", F.col(line)))
    end = F.min_by("wall_clock_s", F.when(F.col("event") == "RUN_END", F.col(line)))
    ended = F.max((F.col("event") == "RUN_END").cast("int")) == 1
    began = F.max((F.col("event") == "RUN_START").cast("int")) == 1
    return events.groupBy("run_id").agg(F.when(began, F.when(ended, end).otherwise(now - start)).alias("seconds"))


def run_summary(state: DataFrame, quarantine: DataFrame, diagnostics: DataFrame, wall_clock_s: float, points: int | None) -> DataFrame:
    """done (of all time), quarantined (recovered ones too), reasons, papers_per_hour, consistent (null while points are unknown)."""
    done = state.filter("stage = 'done'").agg(F.count("*").alias("done"))
    q = quarantine.agg(F.count("*").alias("quarantined"))
    reasons = diagnostics.groupBy("error_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("reasons"))
    rate = F.when(F.lit(wall_clock_s) > 0, F.col("done") / (F.lit(wall_clock_s) / 3600.0)).otherwise(0.0)
    known = F.lit(None).cast("boolean") if points is None else ~((F.col("done") > 0) & F.lit(points == 0))
    return done.crossJoin(q).crossJoin(reasons).withColumn("papers_per_hour", rate).withColumn("consistent", known)


def throughput(state: DataFrame, started: Column, now: Column, target: int) -> DataFrame:
    """done, run_done, papers_per_hour of this run, eta_s to the target."""
    elapsed = F.unix_timestamp(now) - F.unix_timestamp(started)
    n = state.filter("stage = 'done'").agg(F.count("*").alias("done"), F.count(F.when(F.col("updated_at") >= started, 1)).alias("run_done"))
    return n.withColumn("papers_per_hour", per_hour(F.col("run_done"), elapsed)).withColumn("eta_s", eta_s(F.col("papers_per_hour"), F.col("done"), F.lit(target)))


def batch_sizes(probes: DataFrame, by: str, at: str, start: int = 4, margin: int = 2048, least: int = 1, most: int = 32, step: int = 1) -> DataFrame:
    """by, at, size after each probe (by, at, free INT): half at the margin or below, a step more from twice the margin on, else, and for a null probe, the same.

    Probes pass in order with one size carried from each to the next, so no list of probes is held whole.
    """
    rows = probes.select(by, F.col(at).cast("bigint").alias(at), "free").repartition(by).sortWithinPartitions(by, at, "free")

    def sizes(batches):
        import pyarrow as pa

        of, size = (), start
        for batch in batches:
            out = []
            for key, free in zip(batch[by].to_pylist(), batch["free"].to_pylist(), strict=True):
                if of != (key,):
                    of, size = (key,), start
                if free is not None:
                    size = max(size // 2, least) if free <= margin else min(size + step, most) if free >= 2 * margin else size
                out.append(size)
            yield pa.RecordBatch.from_arrays([batch[by], batch[at], pa.array(out, pa.int32())], [by, at, "size"])

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(by, kinds[by]), T.StructField(at, T.LongType()), T.StructField("size", T.IntegerType())])
    return rows.mapInArrow(sizes, schema)


def decisions(sizes: DataFrame, by: str, at: str) -> DataFrame:
    """`sizes` with the size before and the zone it moved to."""
    old = F.lag("size").over(Window.partitionBy(by).orderBy(at))
    return sizes.withColumn("old", old).withColumn("zone", F.when(F.col("size") < old, "shrink").when(F.col("size") > old, "grow").otherwise("hold"))


def status(state: DataFrame, quarantine: DataFrame, diagnostics: DataFrame, events: DataFrame, cached: DataFrame, started: Column, now: Column, target: int) -> DataFrame:
    """One row of all that a status page shows: funnel, reasons, stage, rates, cache, each an aggregate of one row."""
    from folioflow.operators.state import funnel, quarantine_reasons

    f = funnel(state).agg(F.map_from_entries(F.collect_list(F.struct("stage", "reached"))).alias("funnel"))
    reasons = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "reason", "n")))
    r = quarantine_reasons(quarantine, diagnostics, state).agg(F.transform(reasons, lambda x: F.struct(x["reason"].alias("reason"), x["n"].alias("count"))).alias("quarantine_reasons"))
    s = current_stage(latest_run(events)).agg(F.max("stage").alias("stage"))
    c = cached.agg(F.count("*").alias("cached"))
    return f.crossJoin(r).crossJoin(s).crossJoin(throughput(state, started, now, target)).crossJoin(c)
