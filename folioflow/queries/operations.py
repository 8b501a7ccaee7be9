"""Pipeline state, corpus building, telemetry, snapshots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import upper
from folioflow.operators import corpus, state as st, telemetry
from folioflow.queries.views import BLOCKS, PAPERS, QUARANTINE, STATE, with_
from folioflow.sinks import notes, snapshots
from folioflow.sources import tables
from folioflow.sources.tables import table


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.failures(spark, sf_dir).select("paper_id", F.col("event_id").alias("ts"), "error")
    return st.quarantined(f)


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth reason has none."""
    k = F.get_json_object("error", "$.k").cast("int")
    return _quarantine(spark, sf_dir).filter(k % 5 != 0).select("paper_id", F.when(k % 2 == 0, "PermanentError").otherwise("TransientError").alias("error_type"))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.papers(spark, sf_dir).select("paper_id", "published", "categories")


def checkpoint_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.state(spark, sf_dir)
    old = s.select("paper_id", "stage", F.concat(F.lit("p"), F.col("paper_id")).alias("parsed"), F.lit(None).cast("string").alias("summary"))
    new = s.filter("stage <> 'harvested'").select("paper_id", F.when(F.col("stage") == "stored", "done").otherwise(F.col("stage")).alias("stage"), F.lit(None).cast("string").alias("parsed"), F.concat(F.lit("s"), F.col("paper_id")).alias("summary"))
    return st.merged_checkpoints(old, new, ["parsed", "summary"])


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language replaced by their upper-case texts, with rows for papers not seen before."""
    d = table(spark, sf_dir, "documents")
    old = d.filter("lang IS DISTINCT FROM 'es'").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("text").alias("title"))
    new = d.filter("lang IN ('es', 'fr')").select(F.col("doc_id").cast("string").alias("paper_id"), upper(F.col("text")).alias("title"))
    return st.upserted(old, new)


def cascade_delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.blocks(spark, sf_dir).select(F.col("block_id").alias("chunk_id"), "paper_id")
    s = tables.papers(spark, sf_dir).select(F.concat(F.col("paper_id"), F.lit(":summary")).alias("summary_id"), "paper_id")
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("paper_id"))
    return st.cascade_ids(b, s, gone)


def quarantine_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quarantine(spark, sf_dir)


def resume_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = tables.papers(spark, sf_dir).select("paper_id")
    return st.worklist(refs, tables.state(spark, sf_dir), "stored")


def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.funnel(tables.state(spark, sf_dir)).select("stage", F.col("ord").cast("long").alias("ord"), "reached")


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.quarantine_reasons(_quarantine(spark, sf_dir), _diagnostics(spark, sf_dir), tables.state(spark, sf_dir))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = telemetry.run_summary(tables.state(spark, sf_dir), _quarantine(spark, sf_dir), _diagnostics(spark, sf_dir), 7200.0, 0)
    return r.select("done", "quarantined", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("reasons"), F.round("papers_per_hour", 9).alias("papers_per_hour"), "consistent")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_type").alias("stage"), F.when(k % 10 == 0, 0).otherwise(k).alias("util"), (F.col("user_id") * 10).alias("mem"), F.when(k % 3 != 0, F.col("value")).alias("power"))


def gpu_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = telemetry.gpu_by_stage(_samples(spark, sf_dir))
    return g.select("stage", *[F.round(c, 6).alias(c) for c in ("mean_util", "pct_high", "mean_power")], "peak_mem", "n")


def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).withColumnRenamed("stage", "config")
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config")).agg(F.count("*").alias("total_pages"), F.lit(90.0).alias("elapsed_s")).withColumn("oom", F.col("config") == "error")
    b = telemetry.benchmark_stats(s, runs)
    return b.select("config", "total_pages", "elapsed_s", "oom", *[F.round(c, 6).alias(c) for c in ("avg_util", "pct_zero", "pct_high", "peak_mem", "pages_per_minute")], "n_samples")


def throughput_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = lambda t: F.to_timestamp(F.lit(t))
    s = tables.state(spark, sf_dir).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    t = telemetry.throughput(s, ts("2024-01-29 00:00:00"), ts("2024-01-31 00:00:00"), 1000)
    return t.select("done", "run_done", F.round("papers_per_hour", 9).alias("papers_per_hour"), F.round("eta_s", 3).alias("eta_s"))


def done_count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.done_count(tables.state(spark, sf_dir), _papers(spark, sf_dir), date(2020, 1, 10), date(2023, 1, 1), ["en", "src3"])


def integrity_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents have chunks; documents of the first source have no blocks."""
    chunks = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("paper_id"))
    blocks = tables.blocks(spark, sf_dir).join(tables.papers(spark, sf_dir).filter("NOT array_contains(categories, 'src0')"), "paper_id", "left_semi")
    return st.incomplete(tables.state(spark, sf_dir), tables.papers(spark, sf_dir), chunks, blocks)


def known_ids_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.known_ids(tables.state(spark, sf_dir), _quarantine(spark, sf_dir))


def cached_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.cached_not_done(tables.papers(spark, sf_dir), tables.state(spark, sf_dir), _diagnostics(spark, sf_dir))


def stranded_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cached_not_done(spark, sf_dir)
    s = tables.state(spark, sf_dir)
    first, fresh = corpus.by_policy(c, s, "finish_first"), corpus.by_policy(c, s, "ignore")
    return first.withColumn("policy", F.lit("finish_first")).unionByName(fresh.withColumn("policy", F.lit("ignore")))


def relevance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = table(spark, sf_dir, "embeddings").filter("label < 3").select(F.col("vec_id").cast("string").alias("paper_id"), (F.col("label") * 1000 + F.col("vec_id")).alias("rank"))
    return corpus.by_relevance(cached_not_done(spark, sf_dir), ranking).select("paper_id", F.col("rank").cast("long").alias("rank"))


def round_robin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shards(table(spark, sf_dir, "documents").select("doc_id"), 4, "doc_id").withColumn("shard", F.col("shard").cast("long"))


def prefetch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, ids = tables.papers(spark, sf_dir), lambda df: df.select("paper_id")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), "toxic")
    return corpus.prefetch_list(ids(p), ids(tables.state(spark, sf_dir)), ids(labels), ids(_quarantine(spark, sf_dir)))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run's log: a run for each day."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "STAGE_START").when(F.col("event_type") == "click", "STAGE_END").when(F.col("event_type") == "signup", "RUN_START").when((F.col("event_type") == "purchase") & (F.col("user_id") % 50 == 0), "RUN_END").otherwise("OTHER")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("line_no"), kind.alias("event"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("stage"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("value").alias("wall_clock_s"))


def latest_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.latest_run(_log(spark, sf_dir)).select("run_id", "line_no", "event", "stage")


def current_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.current_stage(_log(spark, sf_dir))


def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.wall_clock(_log(spark, sf_dir), F.lit(1706745600.0)).select("run_id", F.round("seconds", 6).alias("seconds"))


def status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = lambda t: F.to_timestamp(F.lit(t))
    s = tables.state(spark, sf_dir).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    row = telemetry.status(s, _quarantine(spark, sf_dir), _diagnostics(spark, sf_dir), _log(spark, sf_dir), tables.papers(spark, sf_dir), ts("2024-01-29 00:00:00"), ts("2024-01-31 00:00:00"), 1000)
    return row.select(F.col("funnel")["done"].alias("done"), F.col("funnel")["harvested"].alias("harvested"), F.array_join(F.transform("quarantine_reasons", lambda r: F.concat_ws("=", r["reason"], r["count"].cast("string"))), ",").alias("reasons"), "stage", "run_done", F.round("papers_per_hour", 9).alias("papers_per_hour"), "cached")


def aimd_batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    probes = e.select("user_id", F.col("event_id"), F.when(k % 13 != 0, k * 80).alias("free"))
    return telemetry.batch_sizes(probes, "user_id", "event_id").select("user_id", "event_id", F.col("size").cast("long").alias("size"))


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("documents", "labels", "events", "conversations", "benchmark")
    return snapshots.row_counts({n: table(spark, sf_dir, n) for n in names})


def note_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.papers(spark, sf_dir).withColumn("version", F.lit("v1")).withColumn("authors", F.array(F.lit("A. One"), F.concat(F.lit("S "), F.element_at("categories", 2)))).withColumn("pdf_url", F.concat(F.lit("https://arxiv.org/pdf/"), F.col("paper_id"))).withColumn("summary", F.when(F.col("paper_id").cast("int") % 5 != 0, F.col("markdown")))
    sections = tables.blocks(spark, sf_dir).groupBy("paper_id").agg(F.array_sort(F.collect_set("section_path")).alias("sections"))
    return notes.rendered(p.join(sections, "paper_id", "left")).select("paper_id", "file", F.md5("note").alias("note_md5"))


QUERIES = {f.__name__: f for f in (checkpoint_merge, upsert_replace, cascade_delete_ids, quarantine_first_wins, resume_worklist, stage_funnel, quarantine_reasons, run_summary, gpu_by_stage, benchmark_stats, throughput_eta, done_count_filtered, integrity_offenders, known_ids_union, cached_not_done, stranded_policy, relevance_order, round_robin_shards, prefetch_list, latest_run_events, current_stage, wall_clock, status_view, aimd_batch_sizes, snapshot_counts, note_export)}

_STAGES = "['harvested', 'parsed', 'chunked', 'summarized', 'embedded', 'stored', 'done']"
_OPEN = """cached AS (SELECT DISTINCT cast(doc_id AS VARCHAR) AS paper_id FROM documents),
open AS (SELECT paper_id FROM cached ANTI JOIN (SELECT paper_id FROM state WHERE stage = 'done') USING (paper_id) ANTI JOIN (SELECT paper_id FROM diagnostics WHERE error_type = 'PermanentError') d USING (paper_id))"""
_K = "cast(json_extract(props, '$.k') AS INTEGER)"
_SAMPLES = f"samples AS (SELECT event_type AS stage, CASE WHEN {_K} % 10 = 0 THEN 0 ELSE {_K} END AS util, user_id * 10 AS mem, CASE WHEN {_K} % 3 <> 0 THEN value END AS power FROM events)"
_LOG = """log AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_id AS line_no, CASE WHEN event_type = 'view' THEN 'STAGE_START' WHEN event_type = 'click' THEN 'STAGE_END' WHEN event_type = 'signup' THEN 'RUN_START' WHEN event_type = 'purchase' AND user_id % 50 = 0 THEN 'RUN_END' ELSE 'OTHER' END AS event,
  's' || (user_id % 3) AS stage, floor(epoch(ts)) AS ts, value AS wall_clock_s FROM events)"""

_QUOTE = "chr(39)"
_QUOTED = f"{_QUOTE} || replace({{0}}, {_QUOTE}, {_QUOTE} || {_QUOTE}) || {_QUOTE}"
_ITEMS = f"array_to_string(list_transform({{0}}, lambda x: chr(10) || '- ' || {_QUOTED.format('x')}), '')"

SQL = {
    "note_export": with_(BLOCKS, "parts AS (SELECT paper_id, list_sort(list(DISTINCT section_path)) AS sections FROM blocks GROUP BY 1)", "p AS (SELECT cast(doc_id AS VARCHAR) AS paper_id, doc_id, split_part(text, chr(10), 1) AS title, lang, source, text, cast(cast(DATE '2020-01-01' + cast(doc_id % 1500 AS INTEGER) AS DATE) AS VARCHAR) AS day FROM documents)")
    + f"""SELECT paper_id, paper_id || '.md' AS file, md5('---' || chr(10) || 'title: ' || {_QUOTED.format('title')} || chr(10) || 'arxiv_id: ' || paper_id || 'v1' || chr(10) || 'authors:' || {_ITEMS.format("['A. One', 'S ' || source]")} || chr(10) || 'categories:' || {_ITEMS.format("[lang, source]")}
|| chr(10) || 'published: ' || {_QUOTED.format('day')} || chr(10) || 'tags:' || {_ITEMS.format("['paper', lang, source]")} || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '**Authors:** [[A. One]], [[S ' || source || ']]' || chr(10) || '**Published:** ' || day
|| chr(10) || '**Source:** [PDF](https://arxiv.org/pdf/' || paper_id || ') · [arXiv](https://arxiv.org/abs/' || paper_id || ')' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || CASE WHEN doc_id % 5 <> 0 AND text <> '' THEN text ELSE '_(no summary stored)_' END || chr(10)
|| chr(10) || '## Sections' || chr(10) || chr(10) || array_to_string(list_transform(sections, lambda s: '- ' || s), chr(10)) || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10) || '_Not yet generated -- deferred to the claim-layer V1 ticket._' || chr(10)) AS note_md5
FROM p JOIN parts USING (paper_id)""",
    "checkpoint_merge": with_(STATE)
    + """SELECT o.paper_id, coalesce(CASE WHEN o.stage = 'harvested' THEN NULL WHEN o.stage = 'stored' THEN 'done' ELSE o.stage END, o.stage) AS stage,
CASE WHEN o.stage NOT IN ('stored', 'done') THEN 'p' || o.paper_id END AS parsed, CASE WHEN o.stage NOT IN ('stored', 'done', 'harvested') THEN 's' || o.paper_id END AS summary FROM state o""",
    "upsert_replace": "SELECT cast(doc_id AS VARCHAR) AS paper_id, CASE WHEN lang IN ('es', 'fr') THEN upper(text) ELSE text END AS title FROM documents",
    "cascade_delete_ids": "WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id || ':b' || (generate_subscripts(string_split(text, chr(10)), 1) - 1) AS id FROM documents SEMI JOIN gone USING (doc_id) UNION ALL SELECT doc_id || ':summary' FROM documents SEMI JOIN gone USING (doc_id)",
    "quarantine_first_wins": with_(QUARANTINE) + "SELECT paper_id, event_id AS ts, error FROM quarantine",
    "resume_worklist": with_(STATE) + "SELECT cast(doc_id AS VARCHAR) AS paper_id, stage FROM documents LEFT JOIN state ON paper_id = cast(doc_id AS VARCHAR) WHERE stage IS NULL OR stage NOT IN ('stored', 'done')",
    "stage_funnel": with_(STATE, f"stages AS (SELECT unnest({_STAGES}) AS stage, unnest(range(7)) AS ord)") + "SELECT s.stage, s.ord, cast((SELECT count(*) FROM state t WHERE list_position(" + _STAGES + ", t.stage) - 1 >= s.ord) AS BIGINT) AS reached FROM stages s",
    "quarantine_reasons": with_(STATE, QUARANTINE, "q AS (SELECT * FROM quarantine ANTI JOIN (SELECT paper_id FROM state WHERE stage = 'done') USING (paper_id))", "d AS (SELECT error_type AS reason, count(*) AS n FROM diagnostics SEMI JOIN q USING (paper_id) GROUP BY 1)")
    + "SELECT reason, n FROM d UNION ALL SELECT * FROM (SELECT 'unknown (quarantined before diagnostics were recorded)' AS reason, (SELECT count(*) FROM q) - (SELECT cast(coalesce(sum(n), 0) AS BIGINT) FROM d) AS n) WHERE n > 0",
    "run_summary": with_(STATE, QUARANTINE) + "SELECT (SELECT count(*) FROM state WHERE stage = 'done') AS done, (SELECT count(*) FROM quarantine) AS quarantined, (SELECT string_agg(error_type || '=' || n, ',' ORDER BY error_type) FROM (SELECT error_type, count(*) AS n FROM diagnostics GROUP BY 1)) AS reasons, round((SELECT count(*) FROM state WHERE stage = 'done') / 2.0::DOUBLE, 9) AS papers_per_hour, NOT ((SELECT count(*) FROM state WHERE stage = 'done') > 0) AS consistent",
    "gpu_by_stage": with_(_SAMPLES) + "SELECT stage, round(avg(util), 6) AS mean_util, round(avg(CASE WHEN util >= 90 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS pct_high, round(avg(power), 6) AS mean_power, max(mem) AS peak_mem, count(*) AS n FROM samples GROUP BY 1",
    "benchmark_stats": with_(_SAMPLES) + "SELECT stage AS config, count(*) AS total_pages, 90.0::DOUBLE AS elapsed_s, stage = 'error' AS oom, " + ", ".join(f"round(CASE WHEN stage = 'error' THEN 0 ELSE {x} END, 6) AS {n}" for x, n in (("avg(util)", "avg_util"), ("avg(CASE WHEN util = 0 THEN 1.0::DOUBLE ELSE 0 END) * 100", "pct_zero"), ("avg(CASE WHEN util >= 90 THEN 1.0::DOUBLE ELSE 0 END) * 100", "pct_high"), ("cast(max(mem) AS DOUBLE)", "peak_mem"), ("count(*) / 1.5::DOUBLE", "pages_per_minute"))) + ", count(*) AS n_samples FROM samples GROUP BY stage",
    "throughput_eta": with_(STATE, "n AS (SELECT count(*) AS done, count(*) FILTER (updated_at >= TIMESTAMP '2024-01-29') AS run_done FROM state WHERE stage = 'done')") + "SELECT done, run_done, CASE WHEN run_done > 0 THEN round(run_done / 48.0::DOUBLE, 9) END AS papers_per_hour, CASE WHEN run_done > 0 AND done < 1000 THEN round((1000 - done) / (run_done / 48.0::DOUBLE) * 3600, 3) END AS eta_s FROM n",
    "done_count_filtered": with_(STATE, PAPERS) + "SELECT count(*) AS done FROM state JOIN papers USING (paper_id) WHERE stage = 'done' AND published BETWEEN DATE '2020-01-10' AND DATE '2023-01-01' AND list_has_any(categories, ['en', 'src3'])",
    "integrity_offenders": with_(STATE) + """SELECT paper_id, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS n_chunks, CASE WHEN source = 'src0' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_blocks
FROM state JOIN documents d ON paper_id = cast(doc_id AS VARCHAR) WHERE stage = 'done' AND (source = 'src0' OR doc_id NOT IN (SELECT doc_id FROM labels))""",
    "known_ids_union": with_(STATE, QUARANTINE) + "SELECT paper_id FROM state UNION SELECT paper_id FROM quarantine",
    "cached_not_done": with_(STATE, QUARANTINE, _OPEN) + "SELECT paper_id FROM open",
    "stranded_policy": with_(STATE, QUARANTINE, _OPEN, "marked AS (SELECT paper_id, paper_id IN (SELECT paper_id FROM state) AS begun FROM open)")
    + "SELECT paper_id, 'finish_first' AS policy FROM marked WHERE begun = (SELECT coalesce(bool_or(begun), false) FROM marked) UNION ALL SELECT paper_id, 'ignore' FROM marked WHERE NOT begun",
    "relevance_order": with_(STATE, QUARANTINE, _OPEN) + "SELECT paper_id, rank FROM (SELECT paper_id, label * 1000 + vec_id AS rank FROM open LEFT JOIN (SELECT * FROM embeddings WHERE label < 3) ON paper_id = cast(vec_id AS VARCHAR) ORDER BY rank ASC NULLS LAST, paper_id LIMIT 500)",
    "round_robin_shards": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents",
    "prefetch_list": with_(STATE, QUARANTINE) + "SELECT cast(doc_id AS VARCHAR) AS paper_id FROM documents WHERE cast(doc_id AS VARCHAR) NOT IN (SELECT paper_id FROM state UNION SELECT paper_id FROM quarantine UNION SELECT cast(doc_id AS VARCHAR) FROM labels)",
    "latest_run_events": with_(_LOG) + "SELECT run_id, line_no, event, stage FROM log WHERE run_id = (SELECT arg_max(run_id, line_no) FROM log)",
    "current_stage": with_(_LOG, "steps AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS n, count(*) OVER (PARTITION BY run_id) AS total FROM log WHERE event IN ('STAGE_START', 'STAGE_END', 'RUN_END'))",
        """walk AS (SELECT run_id, n, total, CASE event WHEN 'STAGE_START' THEN stage WHEN 'RUN_END' THEN 'done' END AS s FROM steps WHERE n = 1
  UNION ALL SELECT t.run_id, t.n, t.total, CASE WHEN event = 'STAGE_START' THEN stage WHEN event = 'STAGE_END' AND stage IS NOT DISTINCT FROM s THEN NULL WHEN event = 'RUN_END' THEN 'done' ELSE s END FROM walk w JOIN steps t ON t.run_id = w.run_id AND t.n = w.n + 1)""", recursive=True) + "SELECT run_id, s AS stage FROM walk WHERE n = total",
    "wall_clock": with_(_LOG) + "SELECT run_id, CASE WHEN count(*) FILTER (event = 'RUN_START') > 0 THEN round(coalesce(arg_min(wall_clock_s, line_no) FILTER (event = 'RUN_END'), 1706745600.0::DOUBLE - arg_min(ts, line_no) FILTER (event = 'RUN_START')), 6) END AS seconds FROM log GROUP BY 1",
    "status_view": with_(STATE, QUARANTINE, _LOG, "q AS (SELECT * FROM quarantine ANTI JOIN (SELECT paper_id FROM state WHERE stage = 'done') USING (paper_id))", "d AS (SELECT error_type AS reason, count(*) AS n FROM diagnostics SEMI JOIN q USING (paper_id) GROUP BY 1)",
        "r AS (SELECT reason, n FROM d UNION ALL SELECT 'unknown (quarantined before diagnostics were recorded)', (SELECT count(*) FROM q) - (SELECT cast(coalesce(sum(n), 0) AS BIGINT) FROM d))",
        "steps AS (SELECT *, row_number() OVER (ORDER BY line_no) AS n, count(*) OVER () AS total FROM log WHERE event IN ('STAGE_START', 'STAGE_END', 'RUN_END') AND run_id = (SELECT arg_max(run_id, line_no) FROM log))",
        """walk AS (SELECT n, total, CASE event WHEN 'STAGE_START' THEN stage WHEN 'RUN_END' THEN 'done' END AS s FROM steps WHERE n = 1
  UNION ALL SELECT t.n, t.total, CASE WHEN event = 'STAGE_START' THEN stage WHEN event = 'STAGE_END' AND stage IS NOT DISTINCT FROM s THEN NULL WHEN event = 'RUN_END' THEN 'done' ELSE s END FROM walk w JOIN steps t ON t.n = w.n + 1)""", recursive=True)
    + """SELECT (SELECT count(*) FROM state WHERE stage = 'done') AS done, (SELECT count(*) FROM state) AS harvested, (SELECT string_agg(reason || '=' || n, ',' ORDER BY n DESC, reason) FROM r WHERE n > 0) AS reasons, (SELECT s FROM walk WHERE n = total) AS stage,
  (SELECT count(*) FROM state WHERE stage = 'done' AND updated_at >= TIMESTAMP '2024-01-29') AS run_done, (SELECT CASE WHEN count(*) > 0 THEN round(count(*) / 48.0::DOUBLE, 9) END FROM state WHERE stage = 'done' AND updated_at >= TIMESTAMP '2024-01-29') AS papers_per_hour, (SELECT count(*) FROM documents) AS cached""",
    "aimd_batch_sizes": with_(f"probes AS (SELECT user_id, event_id, CASE WHEN {_K} % 13 <> 0 THEN {_K} * 80 END AS free, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)",
        """walk AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, 4 AS size FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT p.user_id, p.event_id, p.n, CASE WHEN free IS NULL THEN size WHEN free <= 2048 THEN greatest(size // 2, 1) WHEN free >= 4096 THEN least(size + 1, 32) ELSE size END FROM walk w JOIN probes p ON p.user_id = w.user_id AND p.n = w.n + 1)""", recursive=True) + "SELECT user_id, event_id, cast(size AS BIGINT) AS size FROM walk WHERE n > 0",
    "snapshot_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("documents", "labels", "events", "conversations", "benchmark")),
}
