"""Papers as a stream: latest versions, state by micro-batch, loops that end by themselves."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.text import version_number
from folioflow.operators.parsing import latest_versions
from folioflow.operators.state import merged_checkpoints
from folioflow.sinks.snapshots import amend, read


def _of(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The table's rows of a batch's papers."""
    return table.join(batch.select("paper_id").distinct(), "paper_id", "left_semi")


def latest_refs(feed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the table at `path` at the latest version of each paper of an unbounded feed (paper_id, version, seen, ...).

    Only the papers of a batch are merged and written: doing it again after a failure gives the same table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        old = read(spark, path)
        amend(latest_versions(batch if old is None else _of(old, batch).unionByName(batch)), path, "paper_id")

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoints(updates: DataFrame, path: str, checkpoint: str, artifacts: list[str]) -> StreamingQuery:
    """Keep the state table at `path` merged with a stream of checkpoint updates (paper_id, stage, artifacts, at)."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("paper_id").agg(F.max_by("stage", "at").alias("stage"), *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("at"))).alias(a) for a in artifacts])
        old = read(spark, path)
        old = new.limit(0) if old is None else _of(old, new)
        amend(merged_checkpoints(old, new, artifacts), path, "paper_id")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rising_versions(feed: DataFrame) -> DataFrame:
    """Rows of a stream (paper_id, version) that are newer than all before of their paper; state is one number a paper."""
    import pandas as pd

    def newer(key, frames, state):
        best = state.get[0] if state.exists else -1
        out = []
        for pdf in frames:
            for v in pdf["number"]:
                if v > best:
                    best = int(v)
                    out.append(best)
        state.update((best,))
        yield pd.DataFrame({"paper_id": [key[0]] * len(out), "number": out})

    numbered = feed.select("paper_id", version_number(F.col("version")).alias("number"))
    return numbered.groupBy("paper_id").applyInPandasWithState(newer, "paper_id string, number int", "best int", "append", "NoTimeout")


def build_to_target(ingest: Callable[[list[str]], None], candidates: Callable[[], list[str]], done: Callable[[], int], target: int, downloading: Callable[[], bool] = lambda: False, batch: int = 500, most_idle: int = 12, wait_s: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Batches of candidates until `target` are done. How it ended: reached, exhausted (none left, none coming) or stalled.

    A batch that brings nobody forward counts as idle, as does a wait for more.
    """
    idle = 0
    while True:
        before = done()
        if before >= target:
            return "reached"
        ids = candidates()[:batch]
        if ids:
            ingest(ids)
            if done() > before:
                idle = 0
                continue
        elif not downloading():
            return "exhausted"
        idle += 1
        if idle >= most_idle:
            return "stalled"
        sleep(wait_s)


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by window and type, late ones dropped. An extension: batch pipelines have no event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
