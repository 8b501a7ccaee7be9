"""Building a corpus to a target: references from the feed, batches of what is cached and not done, by the settings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.config import Config
from folioflow.functions.dates import compact_date
from folioflow.operators import corpus
from folioflow.plans.ingest import Store
from folioflow.sinks.scratch import kept
from folioflow.sources import atom

_STATE, _FAILED = "paper_id string, stage string", "paper_id string, error_type string"


def harvested(spark: SparkSession, settings: Config, known: DataFrame | None = None, **feed: str) -> DataFrame:
    """The references that the settings ask for: named ids, or the first `corpus_cap` of the queries in their ordering, categories and dates. feed: fetch or folder, attempts, pause_s."""
    if settings.ingest_paper_ids:
        refs = atom.fetched_by_ids(spark, list(settings.ingest_paper_ids), **feed)
        return refs if known is None else refs.join(known.select("paper_id"), "paper_id", "left_anti")
    limits = {"after": settings.arxiv_date_from, "before": settings.arxiv_date_to, "categories": settings.arxiv_categories and json.dumps(settings.arxiv_categories)}
    return atom.harvest(spark, list(settings.focus_area_queries), settings.corpus_cap, known, ordering=settings.ordering, **{k: v for k, v in limits.items() if v}, **feed)


def _state(store: Store) -> tuple[DataFrame, DataFrame]:
    s, q = store.table("state"), store.table("quarantine")
    none = lambda schema: store.spark.createDataFrame([], schema)
    return none(_STATE) if s is None else s.select("paper_id", "stage"), none(_FAILED) if q is None else q.select("paper_id", "error_type")


def candidates(store: Store, cached: DataFrame, settings: Config, ranking: DataFrame | None = None, most: int = corpus.BATCH) -> DataFrame:
    """paper_id of the next batch, as a table: cached papers that are neither done nor failed for good, under the policy for stranded ones, the first `most` by rank
    (paper_id, rank; unranked ones after, by id) where the ordering is by relevance, else by id."""
    state, failed = _state(store.here())
    out = corpus.by_policy(corpus.cached_not_done(cached, state, failed), state, settings.stranded_policy)
    if settings.ordering == "relevance" and ranking is not None:
        out = corpus.by_relevance(out, ranking, most)
    else:
        out = out.orderBy("paper_id").limit(most)
    return kept(out.select("paper_id"), "candidates")


def done(store: Store, settings: Config) -> int:
    """Papers that count towards a target: done, within the settings' dates and categories."""
    now = store.here()
    papers = now.table("papers")
    if papers is None:
        return 0
    after, before = compact_date(settings.arxiv_date_from), compact_date(settings.arxiv_date_to)
    return corpus.done_count(_state(now)[0], papers, after, before, settings.arxiv_categories).first().done


def build(
    store: Store, settings: Config, cached: Callable[[], DataFrame], ingest_batch: Callable[[DataFrame], None], target: int | None = None, ranking: DataFrame | None = None,
    batch: int = corpus.BATCH, downloading: Callable[[], bool] = lambda: False, most_idle: int = 12, wait_s: float = 300.0, sleep: Callable[[float], None] = time.sleep,
) -> str:
    """Batches of candidates until `target` (the settings' cap without one) papers are done. How it ended: reached, exhausted (none left, none coming) or stalled.

    A batch stays a table of at most `batch` ids. One that brings nobody forward counts as idle, as does a wait for more.
    """
    target, idle = target or settings.corpus_cap, 0
    while True:
        before = done(store, settings)
        if before >= target:
            return "reached"
        ids = candidates(store, cached(), settings, ranking, batch)
        if not ids.isEmpty():
            ingest_batch(ids)
            if done(store, settings) > before:
                idle = 0
                continue
        elif not downloading():
            return "exhausted"
        idle += 1
        if idle >= most_idle:
            return "stalled"
        sleep(wait_s)


def prefetched(spark: SparkSession, refs: DataFrame, handled: DataFrame, cached: DataFrame, skipped: DataFrame, download: Callable[[list[str]], list[bytes]], path: str, attempts: int = 3, wait_s: float = 1.0) -> DataFrame:
    """PDFs of references that nobody has yet, to `path` with their sidecars; paper_id, error_type, error of those that failed or aren't PDFs.

    download: urls to contents, tried again with waits. What was cached stays whatever else fails, so the same call again goes on from there.
    """
    from pyspark.sql import types as T

    from folioflow.operators import models
    from folioflow.operators.parsing import bad_document
    from folioflow.sources.files import cache

    todo = corpus.prefetch_list(refs, handled, cached, skipped)
    got = kept(todo.withColumn("r", models.guarded(download, attempts, value=T.BinaryType(), wait_s=wait_s)("pdf_url")), "downloads")
    why = bad_document(F.col("r.value"))
    cache(got.filter(F.col("r.ok") & why.isNull()).select(*refs.columns, F.col("r.value").alias("content")), path)
    return got.filter(~F.col("r.ok") | why.isNotNull()).select("paper_id", F.coalesce("r.error_type", F.lit("PermanentError")).alias("error_type"), F.coalesce("r.error", why).alias("error"))
