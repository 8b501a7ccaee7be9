import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from folioflow.config import Config
from folioflow.functions.dates import compact_date
from folioflow.operators import corpus, evaluation, models, ordering, search, state, telemetry
from folioflow.operators.search import Filters
from folioflow.sinks import notes, snapshots
from folioflow.sources import atom, files
from folioflow.streaming import ingest as stream


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "paper_id string")


def stages(spark, **counts):
    return spark.createDataFrame([(f"{s}{i}", s) for s, n in counts.items() for i in range(n)], "paper_id string, stage string")


def test_funnel(spark):
    got = {r.stage: r.reached for r in state.funnel(stages(spark, harvested=2, parsed=1, done=3)).collect()}
    assert got == {"harvested": 6, "parsed": 4, "chunked": 3, "summarized": 3, "embedded": 3, "stored": 3, "done": 3}


def test_unknown_stage_is_an_error(spark):
    with pytest.raises(Exception, match="unknown stage"):
        stages(spark, nowhere=1).select(state.stage_order(F.col("stage"))).collect()


def test_quarantine(spark):
    q = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "x"), ("c", 1, "y")], "paper_id string, ts int, error string")
    first = state.quarantined(q)
    assert {(r.paper_id, r.error) for r in first.collect()} == {("a", "first"), ("b", "x"), ("c", "y")}
    again = state.quarantined(spark.createDataFrame([("a", 0, "new"), ("d", 5, "z")], q.schema), first)
    assert {(r.paper_id, r.error) for r in again.collect()} == {("a", "first"), ("b", "x"), ("c", "y"), ("d", "z")}
    d = spark.createDataFrame([("a", "PermanentError")], "paper_id string, error_type string")
    done = spark.createDataFrame([("b", "done")], "paper_id string, stage string")
    got = {r.reason: r.n for r in state.quarantine_reasons(first, d, done).collect()}
    assert got == {"PermanentError": 1, "unknown (quarantined before diagnostics were recorded)": 1}


def test_checkpoint_merge_and_done_clears(spark):
    schema = "paper_id string, stage string, parsed string, summary string"
    old = spark.createDataFrame([("a", "parsed", "P", None), ("b", "parsed", "P", None)], schema)
    new = spark.createDataFrame([("a", "summarized", None, "S"), ("b", "done", None, None), ("c", "parsed", "Q", None)], schema)
    got = {tuple(r) for r in state.merged_checkpoints(old, new, ["parsed", "summary"]).collect()}
    assert got == {("a", "summarized", "P", "S"), ("b", "done", None, None), ("c", "parsed", "Q", None)}


def test_integrity(spark):
    done = spark.createDataFrame([("none", "done"), ("blocks", "done"), ("ok", "done"), ("early", "parsed")], "paper_id string, stage string")
    got = state.incomplete(done, ids(spark, "none", "blocks", "ok", "early"), ids(spark, "ok", "ok"), ids(spark, "ok", "blocks")).collect()
    assert {(r.paper_id, r.n_chunks, r.n_blocks) for r in got} == {("none", 0, 0), ("blocks", 0, 1)}


def test_policies_and_counts(spark):
    c, s = ids(spark, "a", "b", "c"), spark.createDataFrame([("b", "parsed")], "paper_id string, stage string")
    names = lambda df: sorted(r.paper_id for r in df.collect())
    assert names(corpus.by_policy(c, s)) == ["b"]
    assert names(corpus.by_policy(c, s.limit(0))) == ["a", "b", "c"]
    assert names(corpus.by_policy(c, s, "ignore")) == ["a", "c"]
    with pytest.raises(ValueError):
        corpus.by_policy(c, s, "other")
    ranking = spark.createDataFrame([("c", 1)], "paper_id string, rank int")
    assert [r.paper_id for r in corpus.by_relevance(c, ranking, 2).collect()] == ["c", "a"]
    papers = spark.createDataFrame([("a", date(2024, 1, 1), ["x"]), ("b", date(2024, 2, 1), ["y"])], "paper_id string, published date, categories array<string>")
    done = spark.createDataFrame([("a", "done"), ("b", "done")], "paper_id string, stage string")
    count = lambda *x: corpus.done_count(done, papers, *x).collect()[0].done
    assert (count(), count(compact_date("20240102")), count(None, None, []), count(None, None, ["x"])) == (2, 1, 2, 1)


def test_global_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "n int")
    assert all(r.n == r.row for r in ordering.numbered(df, "n").collect())
    assert ordering.numbered(df.limit(0), "n").collect() == []
    assert [r.shard for r in corpus.shards(ids(spark, *"abcde"), 2).orderBy("paper_id").collect()] == [0, 1, 0, 1, 0]


def test_telemetry(spark):
    s = spark.createDataFrame([("a", 95, 10, None), ("a", 0, 30, None), ("b", 50, 5, 2.0)], "stage string, util int, mem int, power double")
    got = {r.stage: r for r in telemetry.gpu_by_stage(s).collect()}
    assert (got["a"].mean_util, got["a"].pct_high, got["a"].peak_mem, got["a"].mean_power) == (47.5, 50.0, 30, None)
    e = spark.createDataFrame([("r1", 0, "STAGE_START", "parse"), ("r1", 1, "STAGE_END", "parse"), ("r2", 2, "STAGE_START", "parse"), ("r2", 3, "STAGE_END", "embed")], "run_id string, line_no int, event string, stage string")
    assert {r.run_id: r.stage for r in telemetry.current_stage(e).collect()} == {"r1": None, "r2": "parse"}
    assert telemetry.latest_run(e).count() == 2
    p = spark.createDataFrame([(1, i, f) for i, f in enumerate([5000, 5000, 100, None, 3000])], "k int, at int, free int")
    assert [r.size for r in telemetry.batch_sizes(p, "k", "at").orderBy("at").collect()] == [5, 6, 3, 3, 3]


def test_evaluation(spark):
    q = spark.createDataFrame([("q1", "a", ["p1", "p2"], None), ("q2", "a", ["p9"], "p9:b0"), ("q3", "b", ["p1"], "p1:b1")], "question_id string, question_type string, gold_paper_ids array<string>, gold_block_id string")
    r = spark.createDataFrame([("q1", 1, "p3", "x"), ("q1", 2, "p2", "x"), ("q3", 1, "p1", "p1:b1"), ("q2", 11, "p9", "p9:b0")], "question_id string, rank int, paper_id string, block_id string")
    ranks = evaluation.first_ranks(q, r, 10)
    got = {(x.level, x.question_type, x.overall): (x.n, x.recall, x.mrr) for x in evaluation.report(ranks).collect()}
    assert got["paper", None, 1] == (3, pytest.approx(2 / 3), pytest.approx(0.5))
    assert got["paper", "a", 0] == (2, 0.5, 0.25)
    assert got["passage", None, 1] == (2, 0.5, 0.5)


def test_config():
    c = Config(("a",))
    assert c.overlaid(focus_area_queries=("a", "b"), top_k=3).focus_area_queries == ("a", "b")
    for bad in ({"top_k": 0}, {"hybrid_dense_weight": 1.5}, {"ordering": "x"}, {"arxiv_date_from": "May"}):
        with pytest.raises(ValueError):
            Config(("a",), **bad)
    for bad in ({"focus_area_queries": ["a"], "nope": 1}, {"top_k": 3}, {"focus_area_queries": ["a"], "top_k": True}):
        with pytest.raises(ValueError):
            Config.of(bad)
    assert Config.of({"focus_area_queries": ["a"], "db_path": "x", "arxiv_categories": ["cs.LG"]}).arxiv_categories == ("cs.LG",)


FEED = """<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>"""
ENTRY = """<entry><id>http://arxiv.org/abs/{}</id><title> A
 b</title><summary>s</summary><author><name>N N</name></author><category term="stat.ME"/><published>2024-01-02T00:00:00Z</published><updated>2024-01-03T00:00:00Z</updated></entry>"""


def test_feed_source(spark, tmp_path):
    (tmp_path / "x_y-0.xml").write_text(FEED.format(ENTRY.format("2401.00001v9") + ENTRY.format("2401.00002v1")))
    (tmp_path / "x_y-1.xml").write_text(FEED.format(ENTRY.format("2401.00001v10")))
    (tmp_path / "z-0.xml").write_text(FEED.format(ENTRY.format("2401.00003v1")))
    got = atom.harvest(spark, ["x y", "z"], 4, folder=str(tmp_path))
    assert sorted((r.paper_id, r.version, r.title) for r in got.collect()) == [("2401.00001", "v10", "A b"), ("2401.00002", "v1", "A b"), ("2401.00003", "v1", "A b")]
    assert {r.version for r in atom.harvest(spark, ["x y", "z"], 2, folder=str(tmp_path)).collect()} == {"v9", "v1"}
    assert [r.paper_id for r in atom.by_ids(got, ["2401.00003", "gone", "2401.00001"]).collect()] == ["2401.00003", "2401.00001"]


FETCHER = """
import re
LOG = {log!r}
def fetch(request):
    with open(LOG, "a") as f:
        f.write(repr(sorted(request.items())) + "\\n")
    with open(LOG) as f:
        lines = f.read().splitlines()
    if len(lines) == 2:
        raise ConnectionError("once")
    if "id_list" in request:
        return "<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join({entry!r}.format(i + "v1") for i in request["id_list"].split(",")) + "</feed>"
    if request["start"] >= 250:
        return None
    return "<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join({entry!r}.format("2401.%05dv1" % (request["start"] + i)) for i in range(min(request["max_results"], 250 - request["start"]))) + "</feed>"
"""


def test_feed_stops_at_the_cap_and_tries_again(spark, tmp_path):
    log = tmp_path / "requests"
    (tmp_path / "counting_fetcher.py").write_text(FETCHER.format(log=str(log), entry=ENTRY))
    spark.sparkContext.addPyFile(str(tmp_path / "counting_fetcher.py"))
    asked = lambda: log.read_text().splitlines()
    kw = {"fetch": "counting_fetcher:fetch", "pause_s": "0", "ordering": "relevance", "categories": '["cs.LG"]'}
    got = atom.harvest(spark, ["x", "y"], 130, known=ids(spark, "2401.00003"), **kw).collect()
    assert len(got) == 129
    requests = asked()
    assert len(requests) == 3 and "'start', 100" in requests[1] and requests[1] == requests[2]  # a page, one that fails, the same again; none beyond the cap
    assert "('max_results', 30)" in requests[2] and "('sortBy', 'relevance')" in requests[0] and 'all:"x" AND (cat:cs.LG)' in requests[0]
    log.write_text("-\n-\n")
    assert len(atom.fetched_by_ids(spark, [f"2402.{i:05d}" for i in range(120)], fetch="counting_fetcher:fetch", pause_s="0").collect()) == 120
    assert [r.count(",") for r in asked()[2:]] == [r.count(",") for r in asked()[2:]] and len(asked()) == 5
    with pytest.raises(Exception, match="ordering"):
        atom.harvest(spark, ["x"], 1, folder=str(tmp_path), ordering="random").collect()


GROWING = """
import json
LOG, SIZE = {log!r}, {size!r}
def fetch(request):
    with open(LOG, "a") as f:
        f.write(json.dumps(request) + "\\n")
    with open(SIZE) as f:
        n = json.load(f)[0 if '"x"' in request["search_query"] else 1]
    some = range(request["start"], min(n, request["start"] + request["max_results"]))
    base = 1000 if '"x"' in request["search_query"] else 5000
    return "<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join({entry!r}.format("2401.%05dv1" % (base + i)) for i in some) + "</feed>"
"""


def test_feed_gets_filters(spark, tmp_path):
    """A plain filter narrows the query that the feed is asked; Spark applies it as well."""
    log, size = tmp_path / "requests", tmp_path / "size"
    size.write_text("[5, 5]")
    (tmp_path / "growing_fetcher.py").write_text(GROWING.format(log=str(log), size=str(size), entry=ENTRY))
    spark.sparkContext.addPyFile(str(tmp_path / "growing_fetcher.py"))
    feed = lambda: atom._feed(spark, terms='["x"]', fetch="growing_fetcher:fetch", pause_s="0")
    asked = lambda: json.loads(log.read_text().splitlines()[0])["search_query"]
    day = F.col("published")
    for where, query, rows in (
        ((day >= date(2024, 1, 1)) & (day < date(2024, 2, 1)), 'all:"x" AND submittedDate:[202401010000 TO 202402012359]', 5),
        ((day == date(2024, 1, 1)), 'all:"x" AND submittedDate:[202401010000 TO 202401012359]', 0),
        (F.col("primary_category").isin("stat.ME", "cs.LG"), 'all:"x" AND (cat:stat.ME OR cat:cs.LG)', 5),
        (F.array_contains("categories", "cs.LG"), 'all:"x"', 0),
        (F.col("primary_category") == "no such!", 'all:"x"', 0),
    ):
        log.write_text("")
        assert feed().filter(where).count() == rows and asked() == query


def test_feed_as_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    log, size = tmp_path / "requests", tmp_path / "size"
    size.write_text("[250, 30]")
    (tmp_path / "growing_fetcher_2.py").write_text(GROWING.format(log=str(log), size=str(size), entry=ENTRY))
    fetch = f"{tmp_path}/growing_fetcher_2.py:fetch"

    def run():
        s = atom.stream(spark, ["x", "y"], fetch=fetch, pause_s="0", pages="2").select("paper_id", "term_pos", "pos")
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.term_pos, r.pos, r.paper_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    want = lambda x, y: [(0, i, f"2401.{1000 + i:05d}") for i in range(x)] + [(1, i, f"2401.{5000 + i:05d}") for i in range(y)]
    assert run() == want(250, 30)
    requests = [json.loads(r) for r in log.read_text().splitlines()]
    assert {r["sortOrder"] for r in requests} == {"ascending"} and [r["start"] for r in requests if '"x"' in r["search_query"]][:3] == [0, 100, 200]
    size.write_text("[260, 45]")
    assert run() == want(260, 45)  # what came meanwhile, nothing twice
    assert run() == want(260, 45)
    reader = atom.AtomStream({"terms": '["x", "y"]', "fetch": fetch, "pause_s": "0"})
    again = [r[-1] for r in reader.readBetweenOffsets({"read": [90, 0]}, {"read": [210, 0]})]
    assert again == list(range(90, 210))  # a batch again has just its entries
    with pytest.raises(RuntimeError, match="has lost"):
        list(reader.readBetweenOffsets({"read": [0, 45]}, {"read": [0, 50]}))


def test_files_of_rows(spark, tmp_path):
    from folioflow.sinks.file_rows import save

    top = tmp_path / "out"
    save(spark.createDataFrame([("a.md", "one"), ("sub/b.md", "zwei ü"), ("c.md", None)], "file string, value string").repartition(3), str(top))
    assert {str(p.relative_to(top)): p.read_text() for p in top.rglob("*") if p.is_file()} == {"a.md": "one", "sub/b.md": "zwei ü", "c.md": ""}
    # a task that fails midway leaves whole files alone
    rows = spark.range(40, numPartitions=2).select(F.concat(F.lit("n"), "id", F.lit(".md")).alias("file"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.repeat(F.lit("x"), 50_000)).alias("value"))
    with pytest.raises(Exception, match="stop"):
        save(rows, str(top))
    assert {p.stat().st_size for p in top.glob("n*.md")} <= {50_000} and not (top / ".partial").exists()
    for bad in ("../x", "/etc/x", "", None):
        with pytest.raises(Exception, match="not a file's name"):
            save(spark.createDataFrame([(bad, "v")], "file string, value string"), str(top))
    pdfs = spark.createDataFrame([("p1", "v1", "T", bytearray(b"%PDF-1")), ("p2", "v1", "U", bytearray(b"%PDF-2"))], "paper_id string, version string, title string, content binary")
    files.cache(pdfs, str(tmp_path / "cache"))
    assert (tmp_path / "cache/p2.pdf").read_bytes() == b"%PDF-2"
    assert sorted((r.paper_id, r.title) for r in files.sidecars(spark, str(tmp_path / "cache")).collect()) == [("p1", "T"), ("p2", "U")]
    (tmp_path / "md").mkdir()
    (tmp_path / "md/p1.md").write_text("text")
    texts = files.markdown(spark, str(tmp_path / "md"))
    assert [r.markdown for r in files.with_markdown(ids(spark, "p1"), texts).collect()] == ["text"]
    with pytest.raises(Exception, match="no text of paper p9"):
        files.with_markdown(ids(spark, "p9"), texts).collect()


def test_layout_to_store(spark, tmp_path):
    """Layout items and the parser's XML become blocks, references, figures; bytes and XML that can't be read go to quarantine."""
    from folioflow.plans.ingest import Store, ingest_layout

    papers = spark.createDataFrame([(f"p{i}", f"# T{i}\ntext", ["c"], date(2024, 1, 1)) for i in range(4)], "paper_id string, markdown string, categories array<string>, published date")
    box = [100.0, 100.0, 500.0, 200.0]
    items = spark.createDataFrame(
        [(f"p{i}", 0, "text", 0, box, f"words {i}", None, None, None) for i in range(3)] + [(f"p{i}", 1, "list", 0, box, None, "ref_text", ["[1] see doi:10.9999/raw", "[2] arXiv:2401.00001"], None) for i in range(3)] + [("p0", 2, "image", 0, box, None, None, None, "a.png")],
        "paper_id string, pos int, type string, page_idx int, bbox array<double>, text string, sub_type string, list_items array<string>, img_path string",
    )
    for c, kind in (("text_level", "int"), ("table_body", "string"), ("table_caption", "array<string>"), ("image_caption", "array<string>"), ("chart_caption", "array<string>")):
        items = items.withColumn(c, F.lit(None).cast(kind))
    pages = spark.createDataFrame([(f"p{i}", 0, 600.0, 800.0) for i in range(4)], "paper_id string, page_idx int, width double, height double")
    xml = '<TEI><listBibl><biblStruct><analytic><title level="a">One</title></analytic></biblStruct></listBibl></TEI>'
    tei = spark.createDataFrame([("p0", xml), ("p1", "<TEI><broken>"), ("p2", None)], "paper_id string, xml string")
    contents = spark.createDataFrame([(f"p{i}", bytearray(b"\x1f\x8b" if i == 3 else b"%PDF-1")) for i in range(4)], "paper_id string, content binary")
    store = Store(spark, str(tmp_path))
    for _ in range(2):
        ingest_layout(store, papers, items, pages, tei, contents)
        assert {r.paper_id: (r.error_type, r.error) for r in store.table("quarantine").collect()} == {"p1": ("TransientError", "unreadable XML of references"), "p3": ("PermanentError", "gzip")}
        refs = {(r.paper_id, r.pos): (r.title, r.doi, r.arxiv_id) for r in store.table("references").collect()}
        assert refs == {("p0", 0): ("One", "10.9999/raw", None), ("p0", 1): (None, None, "2401.00001"), ("p2", 0): (None, "10.9999/raw", None), ("p2", 1): (None, None, "2401.00001")}
        assert {r.paper_id for r in store.table("state").filter("stage = 'done'").collect()} == {"p0", "p2"} and store.table("figures").count() == 1
    store.delete(ids(spark, "p0"))
    assert {r.paper_id for r in store.table("references").collect()} == {"p2"} and store.table("figures").count() == 0


def test_feed_query():
    assert atom.search_query("a b", ["stat.ME", "cs.LG"], "2024-01-02") == 'all:"a b" AND (cat:stat.ME OR cat:cs.LG) AND submittedDate:[202401020000 TO *]'
    for bad in (('a"b',), ("a", ["BAD!"]), ("a", None, "soon")):
        with pytest.raises(ValueError):
            atom.search_query(*bad)


def test_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"event": "RUN_START", "run_id": "r", "ts": 1.0}\nnot json\n{"event": "RUN_END", "run_id": "r", "wall_clock_s": 9.0}\n')
    e = files.events(spark, str(log))
    assert [r.event for r in e.orderBy("line_no").collect()] == ["RUN_START", "RUN_END"]
    assert telemetry.wall_clock(e, F.lit(5.0)).collect()[0].seconds == 9.0
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"12345")
    (tmp_path / "pdf" / "a.json").write_text("{}")
    assert [tuple(r) for r in files.cached(spark, f"{tmp_path}/pdf").collect()] == [("a", 5)]
    assert tuple(files.cache_totals(spark, f"{tmp_path}/pdf").collect()[0]) == (1, 5)
    (tmp_path / "l.txt").write_text("pace 3/h\nx\npace 7/h\n")
    assert files.last_match(spark, f"{tmp_path}/l.txt", r"pace (\d+)").collect()[0].value == "7"


def test_stage_and_batch_sizes_equal_a_plain_fold_of_random_logs(spark):
    import random

    rng = random.Random(5)
    log, probes, stages, sizes = [], [], {}, {}
    for run in [*range(40), None]:
        now = None
        for line in range(rng.randrange(1, 12)):
            event = rng.choice(["STAGE_START", "STAGE_END", "STAGE_END", "RUN_END", "NOTE"])
            name = rng.choice(["a", "b", "done", None])
            log.append((run, line, event, name))
            if event == "STAGE_START":
                now = name
            elif event == "RUN_END":
                now = "done"
            elif event == "STAGE_END" and now == name:
                now = None
            if event != "NOTE":
                stages[run] = now
        size = 4
        for at in range(rng.randrange(1, 30)):
            free = rng.choice([None, 0, 2048, 2049, 4095, 4096, 9000, 9000])
            probes.append((run, at, free))
            if free is not None:
                size = max(size // 2, 1) if free <= 2048 else min(size + 1, 32) if free >= 4096 else size
            sizes[run, at] = size
    rng.shuffle(log)
    rng.shuffle(probes)
    e = spark.createDataFrame(log, "run_id int, line_no int, event string, stage string")
    assert {r.run_id: r.stage for r in telemetry.current_stage(e).collect()} == stages
    p = spark.createDataFrame(probes, "k int, at int, free int").repartition(3)
    assert {(r.k, r["at"]): r["size"] for r in telemetry.batch_sizes(p, "k", "at").collect()} == sizes
    assert telemetry.batch_sizes(p.limit(0), "k", "at").count() == 0
    assert "collect_list" not in telemetry.current_stage(e)._jdf.queryExecution().executedPlan().toString()


def test_replace_reads_what_it_replaces(spark, tmp_path):
    p = f"{tmp_path}/t"
    assert snapshots.read(spark, p) is None
    snapshots.replace(spark.range(3), p)
    snapshots.replace(snapshots.read(spark, p).filter("id > 0"), p)
    assert snapshots.read(spark, p).count() == 2


def test_replace_stopped_anywhere_leaves_old_or_new(spark, tmp_path, monkeypatch):
    p = f"{tmp_path}/t"
    rows = lambda: sorted(r.id for r in snapshots.read(spark, p).collect())
    snapshots.replace(spark.range(2), p)
    # while it writes: rows without the mark of success
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{p}/rows-000000000001")
    assert rows() == [0, 1]
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        snapshots.replace(broken, p)
    assert rows() == [0, 1]
    # after the writing, before the old rows go
    real = snapshots._fs
    monkeypatch.setattr(snapshots, "_fs", lambda spark, path: (_ for _ in ()).throw(OSError("stop")) if "rows-" in path and "_SUCCESS" not in path else real(spark, path))
    with pytest.raises(OSError, match="stop"):
        snapshots.replace(spark.range(5, 8), p)
    monkeypatch.setattr(snapshots, "_fs", real)
    assert rows() == [5, 6, 7]
    snapshots.replace(snapshots.read(spark, p).union(spark.range(1)), p)
    assert rows() == [0, 5, 6, 7] and len(list((tmp_path / "t").iterdir())) == 2


def _pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int")


def test_amend_writes_new_rows_alone(spark, tmp_path, monkeypatch):
    p = f"{tmp_path}/t"
    # in tables as small as these any layer weighs as much as the rest
    monkeypatch.setattr(snapshots, "_bytes", lambda spark, writings: 0)
    rows = lambda: sorted(((r.k, r.v) for r in snapshots.read(spark, p).collect()), key=repr)
    snapshots.amend(_pairs(spark, ("a", 1), ("a", 2), ("b", 3), (None, 0)), p, "k")
    snapshots.amend(_pairs(spark, ("a", 4), ("c", 5), (None, 9)), p, "k")
    snapshots.amend(_pairs(spark, ("c", 6), ("c", 7)), p, "k")
    want = [("a", 4), ("b", 3), ("c", 6), ("c", 7), (None, 0), (None, 9)]
    assert rows() == want
    assert [f.rsplit("/", 1)[1] for f in snapshots.current(spark, p)] == ["rows-000000000000", "over-000000000001-k", "over-000000000002-k"]
    assert {r.n for r in spark.read.parquet(snapshots.current(spark, p)[1]).groupBy().agg(F.count("*").alias("n")).collect()} == {3}
    # nothing new leaves no layer; other columns are an error; the order and width of columns follow the table
    snapshots.amend(_pairs(spark).limit(0), p, "k")
    assert len(snapshots.current(spark, p)) == 3
    with pytest.raises(ValueError, match="columns differ"):
        snapshots.amend(spark.range(1), p, "id")
    snapshots.amend(spark.sql("SELECT 8L AS v, 'd' AS k"), p, "k")
    assert rows() == sorted([*want, ("d", 8)], key=repr) and dict(snapshots.read(spark, p).dtypes) == {"k": "string", "v": "int"}
    # another key: written whole; the table before stays for its readers
    snapshots.amend(_pairs(spark, ("z", 8)), p, "v")
    assert rows() == sorted([*want, ("z", 8)], key=repr) and len(snapshots.current(spark, p)) == 1
    snapshots.replace(snapshots.read(spark, p), p)
    assert len(list((tmp_path / "t").iterdir())) == 2


def test_amend_stopped_anywhere_leaves_old_or_new_and_folds_in_time(spark, tmp_path, monkeypatch):
    p = f"{tmp_path}/t"
    rows = lambda: sorted((r.k, r.v) for r in snapshots.read(spark, p).collect())
    snapshots.amend(_pairs(spark, ("a", 1), ("b", 1)), p, "k")
    _pairs(spark, ("a", 99)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{p}/over-000000000001-k")
    assert rows() == [("a", 1), ("b", 1)]
    broken = _pairs(spark, ("a", 2)).withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        snapshots.amend(broken, p, "k")
    assert rows() == [("a", 1), ("b", 1)]
    monkeypatch.setattr(snapshots, "MOST_LAYERS", 3)
    monkeypatch.setattr(snapshots, "_bytes", lambda spark, writings: 0)
    seen = set()
    for n in range(2, 10):
        old = snapshots.read(spark, p)
        snapshots.amend(old.filter("k = 'a'").withColumn("v", F.lit(n)), p, "k")
        assert rows() == [("a", n), ("b", 1)] and old.count() == 2
        seen.add(len(snapshots.current(spark, p)))
    assert seen == {1, 2, 3, 4}
    monkeypatch.undo()
    # layers that weigh more than the table are folded into it
    for n in range(10, 14):
        snapshots.amend(_pairs(spark, *[(f"k{i}", n) for i in range(500)]), p, "k")
    assert len(snapshots.current(spark, p)) < 4 and len(rows()) == 502 and {v for k, v in rows() if k.startswith("k")} == {13}


def test_amended_tables_prune_columns_and_rows(spark, tmp_path):
    p = f"{tmp_path}/t"
    for n in range(2):
        snapshots.amend(spark.createDataFrame([("a", n, "text")], "k string, v int, t string"), p, "k")
    plan = snapshots.read(spark, p).filter("k = 'a'").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan and "t:string" not in plan


def test_snapshots_keep_the_newest(spark, tmp_path):
    for n in ("s1", "s2", "s3"):
        snapshots.snapshot({"t": spark.range(4)}, str(tmp_path), 2, n)
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["s2", "s3"]
    m = spark.read.text(f"{tmp_path}/s3/manifest").collect()[0].value
    assert json.loads(m)["rows"] == {"t": 4}


def test_notes(spark):
    p = spark.createDataFrame([("2401.1", "v2", "It's", ["A"], ["cs.LG"], date(2024, 1, 2), "u", None, ["S1", ""])], "paper_id string, version string, title string, authors array<string>, categories array<string>, published date, pdf_url string, summary string, sections array<string>")
    n = notes.rendered(p).collect()[0]
    assert n.file == "2401.1.md" and "arxiv_id: 2401.1v2" in n.note and "title: 'It''s'" in n.note and "- 'cs-LG'" in n.note and "- S1\n" in n.note and "_(no summary stored)_" in n.note
    assert n.note.endswith("## Sections\n\n- S1\n\n## Claims\n\n_Not yet generated -- deferred to the claim-layer V1 ticket._\n")
    assert [r.value for r in notes.index(p).collect()] == ["# Papers Index", "", "1 papers.", "", "- [[2401.1|It's]] (2024-01-02)"]


def test_seams(spark):
    t = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    v = [r.v for r in t.select(models.embedder(models.fake_vectors, models.DIM)("text").alias("v")).collect()]
    assert v[0] == v[2] != v[1] and sum(x * x for x in v[0]) == pytest.approx(1)

    def call(texts):
        if "b" in texts:
            raise ValueError("no b")
        return [x.upper() for x in texts]

    got = [tuple(r.r) for r in t.coalesce(1).select(models.guarded(call)("text").alias("r")).collect()]
    assert got == [(True, "A", None, None), (False, None, "PermanentError", "no b"), (True, "A", None, None)]


def test_streams(spark, tmp_path):
    refs = spark.createDataFrame([("a", "v1", 0), ("a", "v10", 1), ("a", "v9", 2), ("b", "v1", 3)], "paper_id string, version string, seen int")
    refs.write.parquet(f"{tmp_path}/feed")
    feed = lambda: spark.readStream.schema(refs.schema).parquet(f"{tmp_path}/feed")
    stream.latest_refs(feed(), f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination(120)
    refs.limit(1).withColumn("version", F.lit("v11")).write.mode("append").parquet(f"{tmp_path}/feed")
    stream.latest_refs(feed(), f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted((r.paper_id, r.version) for r in snapshots.read(spark, f"{tmp_path}/table").collect()) == [("a", "v11"), ("b", "v1")]
    q = stream.rising_versions(feed()).writeStream.format("memory").queryName("rising").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.awaitTermination(120)
    assert spark.sql("SELECT max(number) AS n FROM rising WHERE paper_id = 'a'").collect()[0].n == 11


def test_build_loop():
    done, cache = [], ["a", "b", "c"]
    run = lambda **k: stream.build_to_target(lambda xs: done.extend(xs), lambda: [c for c in cache if c not in done], lambda: len(done), sleep=lambda s: None, **k)
    assert run(target=2, batch=1) == "reached" and len(done) == 2
    assert run(target=9) == "exhausted"
    assert run(target=9, downloading=lambda: True, most_idle=3) == "stalled"
    assert stream.build_to_target(lambda xs: None, lambda: ["x"], lambda: 0, 1, most_idle=2, sleep=lambda s: None) == "stalled"


def test_ingest_and_tools(spark, tmp_path):
    from folioflow.plans.ingest import Store, ingest
    from folioflow.plans.tools import Tools

    papers = spark.createDataFrame([(f"p{i}", f"# Title {i}\ntext about topic{i}", "t", ["cs.LG"], date(2024, 1, i + 1)) for i in range(3)], "paper_id string, markdown string, title string, categories array<string>, published date")
    blocks = spark.createDataFrame([(f"p{i}:b{j}", f"p{i}", j, "prose", f"topic{i} words {j}", 0, f"S{j}") for i in range(3) for j in range(2)], "block_id string, paper_id string, idx int, type string, text string, page int, section_path string")
    store = Store(spark, str(tmp_path))
    ingest(store, papers, blocks, topic=["topic1"])
    ingest(store, papers, blocks)
    assert store.table("vectors").count() == 9 and store.table("papers").count() == 3
    assert {r.stage for r in store.table("state").collect()} == {"done"}
    plain = Tools(store)._pool("topic1 words 1", Filters(), "chunk", 2)[1].orderBy("rank").collect()
    assert [r.score for r in plain] == sorted((r.score for r in plain), reverse=True)  # the fused order, without a reranker
    # the stored words give what taking the texts apart gives, for every kind and filter, and the scan gets the words
    for f, kind in ((Filters(published_after=date(2024, 1, 2)), "chunk"), (Filters(), "summary")):
        scoped = Filters(f.categories, f.published_after, f.published_before, kind)
        for question in ("topic1 Words 1 words", "", "text about topic2"):
            apart = search.hybrid(store.table("vectors"), Tools(store)._question(question), scoped, 0.5, 32)
            stored = Tools(store)._pool(question, f, kind, 2)[0]
            assert sorted(map(tuple, stored.select("id", "score", "rank").collect())) == sorted(map(tuple, apart.select("id", "score", "rank").collect()))
    scan = Tools(store)._terms(Tools(store)._question("topic1 words"))._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [" in scan
    tools = Tools(store, rerank=lambda q, texts: [float("topic1" in t) for t in texts])
    rows, cover = tools.semantic_search("topic1 words 1", k=2)
    got = rows.collect()
    assert len(got) == 2 and {r.paper_id for r in got} == {"p1"} and cover.collect()[0].candidates == 6
    assert tools.search_papers("topic2", k=5)[0].count() == 3
    assert tools.get_paper("p0").collect()[0].sections == ["S0", "S1"]
    assert tools.get_span("p0:b1").collect()[0].text == "topic0 words 1"
    with pytest.raises(KeyError):
        tools.get_paper("zz")
    gone = store.delete(ids(spark, "p0", "zz"))
    assert {r.id for r in gone.collect()} == {"p0:c0", "p0:c1", "p0:summary"} and store.table("vectors").count() == 6
    assert {r.paper_id for r in store.table("terms").collect()} == {"p1", "p2"}


def test_ingest_goes_on_past_bad_papers_and_stops(spark, tmp_path, capsys):
    from folioflow.__main__ import main
    from folioflow.plans import ingest as plan
    from folioflow.plans.ingest import Store, ingest

    papers = spark.createDataFrame([(f"p{i}", f"# T{i}\ntext {i}", ["c"], date(2024, 1, i + 1)) for i in range(4)], "paper_id string, markdown string, categories array<string>, published date")
    blocks = spark.createDataFrame([(f"p{i}:b0", f"p{i}", 0, "prose", f"words {i}", 0, "S") for i in range(3)], "block_id string, paper_id string, idx int, type string, text string, page int, section_path string")
    store = Store(spark, str(tmp_path))

    def summarize(texts):
        if any("text 1" in t for t in texts):
            raise ValueError("too odd")
        return ["said " + t[-6:] for t in texts]

    def broken(texts):
        raise OSError("no server")

    real = plan.reached
    try:  # a stop between two stages
        plan.reached = lambda c, papers, stage: (_ for _ in ()).throw(KeyboardInterrupt()) if stage == "summarized" else real(c, papers, stage)
        with pytest.raises(KeyboardInterrupt):
            ingest(store, papers, blocks, summarize=summarize, attempts=2)
    finally:
        plan.reached = real
    assert {r.paper_id: r.stage for r in store.table("state").collect()} == {"p0": "chunked", "p1": "chunked", "p2": "chunked"}
    ingest(store, papers, blocks, summarize=summarize, attempts=2, topic=["words"])
    assert {r.paper_id: (r.error_type, r.error) for r in store.table("quarantine").collect()} == {"p1": ("PermanentError", "too odd"), "p3": ("PermanentError", "no blocks")}
    assert {r.paper_id for r in store.table("state").filter("stage = 'done'").collect()} == {"p0", "p2"}
    assert {r.paper_id: r.relevance_score is not None for r in store.table("papers").collect()} == {"p0": True, "p1": False, "p2": True}
    before = store.table("vectors").count()
    ingest(store, papers, blocks, summarize=broken, embed=broken)
    assert store.table("vectors").count() == before and store.table("quarantine").count() == 2
    for command in ("integrity", "funnel", "failures"):
        main(["--store", str(tmp_path), command])
    main(["--store", str(tmp_path), "search", "words 2", "--json"])
    shown = capsys.readouterr().out
    assert "too odd" in shown and '"paper_id": "p2"' in shown
    gone = store.delete(ids(spark, "p0"))
    assert {r.id for r in gone.collect()} == {"p0:c0", "p0:summary"} and {r.paper_id for r in store.table("state").filter("stage = 'done'").collect()} == {"p2"}


def test_small_sources_and_sinks(spark, tmp_path):
    files.append_event(spark, f"{tmp_path}/log", event="RUN_START", run_id="r", ts=1.0)
    files.append_event(spark, f"{tmp_path}/log", event="RUN_END", run_id="r", ts=2.0, wall_clock_s=9.0)
    assert sorted(r.event for r in files.events(spark, f"{tmp_path}/log").collect()) == ["RUN_END", "RUN_START"]
    files.append_decisions(spark.createDataFrame([(4, "halve")], "batch int, why string"), f"{tmp_path}/decisions")
    files.append_decisions(spark.createDataFrame([(2, "grow")], "batch int, why string"), f"{tmp_path}/decisions")
    assert spark.read.option("header", True).csv(f"{tmp_path}/decisions").count() == 2
    wanted = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, paper_id string")
    side = spark.createDataFrame([("a", "A side"), ("b", "B side")], "paper_id string, title string")
    fetched = spark.createDataFrame([("a", "A"), ("c", "C")], "paper_id string, title string")
    pdfs = ids(spark, "b", "c")
    assert [(r.paper_id, r.title) for r in files.sidecar_first(wanted, pdfs, side, fetched).collect()] == [("a", "A"), ("b", "B side"), ("c", "C")]
    assert {r.paper_id for r in files.to_fetch(wanted, pdfs, side).collect()} == {"a", "c"}
    header = lambda t: spark.range(1).select(models.clamped_header(F.lit(t)).alias("x")).first().x
    assert header("  ") == "" and len(header("w " * 900).split()) == models.HEADER_WORDS
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "id string, at int, v string")
    assert {(r.id, r.v) for r in state.last_write(rows, "id", "at").collect()} == {("k", "b"), ("m", "c")}
