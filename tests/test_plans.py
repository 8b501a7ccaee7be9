"""Evaluation and building end to end, from the command line too."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from folioflow.config import Config
from folioflow.plans import build as plan
from folioflow.plans import evaluate
from folioflow.plans.ingest import Store, ingest


def corpus(spark, n):
    papers = spark.createDataFrame([(f"p{i}", f"# T{i}\ntext {i}", ["c" if i % 2 else "d"], date(2024, 1, i + 1)) for i in range(n)], "paper_id string, markdown string, categories array<string>, published date")
    blocks = spark.createDataFrame([(f"p{i}:b{j}", f"p{i}", j, "prose", f"topic{i} words part{j}", 0, f"S{j}") for i in range(n) for j in range(2)], "block_id string, paper_id string, idx int, type string, text string, page int, section_path string")
    return papers, blocks


TRUTH = [
    {"question_id": "q1", "question_text": "topic1 part1", "question_type": "single", "source_paper_id": "p1", "gold_block_id": "p1:b1"},
    {"question_id": "q2", "question_text": "topic3", "question_type": "single", "source_paper_id": "p2", "additional_gold_paper_ids": ["p3", "p2"]},
    {"question_id": "q3", "question_text": "broken topic2", "question_type": "multi", "source_paper_id": "p2", "gold_block_id": "p2:b0"},
]


def test_evaluation_and_its_report(spark, tmp_path, capsys):
    from folioflow.__main__ import main
    from folioflow.operators.evaluation import questions
    from folioflow.sources.files import ground_truth

    papers, blocks = corpus(spark, 5)
    store = Store(spark, str(tmp_path / "store"))

    def embed(texts):
        if any("broken" in t for t in texts):
            raise ValueError("can't read this")
        return [[float(f"topic{i}" in t) + 0.01 for i in range(5)] for t in texts]

    ingest(store, papers, blocks, embed=embed)
    (tmp_path / "truth.json").write_text(json.dumps(TRUTH))
    truth = ground_truth(spark, str(tmp_path / "truth.json"))
    asked = questions(truth, truth)
    ranks = evaluate.evaluated(store, asked, 4, embed)
    got = {r.question_id: r for r in ranks.collect()}
    assert (got["q1"].paper_rank, got["q1"].passage_rank, got["q1"].error) == (1, 2, None)  # two passages that tie, by id
    assert sorted(got["q2"].gold_paper_ids) == ["p2", "p3"] and got["q2"].paper_rank == 1 and not got["q2"].passage_scored
    assert got["q3"].error == "can't read this" and got["q3"].paper_rank is None and got["q3"].passage_scored
    out = evaluate.write(ranks, 4, str(tmp_path / "report"))
    assert (out["n_questions"], out["n_errors"], out["passage_level"]["n_scored"]) == (3, 1, 2)
    assert out["paper_level"]["overall"] == {"recall_at_k": 2 / 3, "mrr": 2 / 3, "n": 3} and out["paper_level"]["by_question_type"]["multi"]["recall_at_k"] == 0
    assert json.loads((tmp_path / "report/report.json").read_text()) == out
    assert out["questions"][1]["passage_level"] == {"scored": False, "hit": False, "rank": None} and out["questions"][2]["error"] == "can't read this"
    assert spark.read.json(str(tmp_path / "report/questions")).count() == 3
    again = evaluate.write(ranks, 4, str(tmp_path / "report"), per_question=False)
    assert "questions" not in again
    # turned round, the best comes last of the pool
    turned = evaluate.evaluated(store, asked, 4, embed, rerank=lambda q, texts: [float("topic4" in t) for t in texts])
    assert {r.question_id: r.paper_rank for r in turned.collect()}["q1"] > 1
    assert evaluate.report(ranks.limit(0), 4)["paper_level"]["overall"] == {"recall_at_k": None, "mrr": None, "n": 0}
    plain = Store(spark, str(tmp_path / "plain"))
    ingest(plain, papers, blocks)
    main(["--store", str(tmp_path / "plain"), "eval", str(tmp_path / "truth.json"), "-k", "3", "--report", str(tmp_path / "r2"), "--limit", "2"])
    assert "2 questions, 0 errors" in capsys.readouterr().out and json.loads((tmp_path / "r2/report.json").read_text())["k"] == 3


def test_questions_and_their_texts(spark):
    from folioflow.operators.evaluation import questions

    schema = "question_id string, question_text string, question_type string, source_paper_id string, additional_gold_paper_ids array<string>, gold_block_id string"
    truth = lambda *rows: spark.createDataFrame([(i, t, "x", "p", more, None) for i, t, more in rows], schema)
    blind = spark.createDataFrame([("a", "blind a"), ("b", "blind b")], "question_id string, question_text string")
    said = lambda t: {r.question_id: (r.text, r.gold_paper_ids) for r in questions(t, blind).collect()}
    assert said(truth(("a", "own a", ["q", "p", "q"]), ("b", "own b", None))) == {"a": ("own a", ["p", "q"]), "b": ("own b", ["p"])}
    assert said(truth(("a", "own a", None), ("b", None, None))) == {"a": ("blind a", ["p"]), "b": ("blind b", ["p"])}
    with pytest.raises(Exception, match="no text"):
        said(truth(("c", None, None)))


def settings(**more):
    return Config.of({"focus_area_queries": ["topic1"], **more})


def test_build_goes_to_its_target(spark, tmp_path):
    papers, blocks = corpus(spark, 7)
    store = Store(spark, str(tmp_path))
    batches = []

    def run(ids, **how):
        batches.append(sorted(r.paper_id for r in ids.collect()))
        own = lambda df: df.join(ids, "paper_id", "left_semi")
        ingest(store, own(papers), own(blocks).filter("paper_id <> 'p2'"), **how)

    ranking = spark.createDataFrame([("p6", 1), ("p2", 2)], "paper_id string, rank int")
    by_rank = settings(ordering="relevance")
    go = lambda conf, **k: plan.build(store, conf, lambda: papers, run, ranking=ranking, batch=2, sleep=lambda s: None, **k)
    assert go(by_rank, target=2) == "reached" and batches == [["p2", "p6"], ["p0", "p1"]]  # p2 has no blocks: it failed for good
    assert go(settings(arxiv_categories=["c"]), target=3) == "reached"
    assert go(settings(), target=99) == "exhausted" and plan.done(store, settings()) == 6
    assert plan.done(store, settings(arxiv_date_from="2024-01-05")) == 3 and plan.done(store, settings(arxiv_categories=["d"])) == 3
    # a stranded paper goes first, or is left out
    with store.change() as c:
        c.put("state", spark.createDataFrame([("p3", "chunked")], "paper_id string, stage string"))
        c.delete("state", spark.createDataFrame([("p4",)], "paper_id string"))
    picked = lambda policy: [r.paper_id for r in plan.candidates(store, papers, settings(stranded_policy=policy)).collect()]
    assert picked("finish_first") == ["p3"] and picked("ignore") == ["p4"]
    stuck = plan.build(store, settings(), lambda: papers, lambda ids: None, 99, most_idle=2, sleep=lambda s: None)
    assert stuck == "stalled" and plan.build(Store(spark, str(tmp_path / "none")), settings(), lambda: papers.limit(0), run, 1) == "exhausted"


def test_failures_for_a_time_are_tried_again(spark, tmp_path):
    papers, blocks = corpus(spark, 2)
    store = Store(spark, str(tmp_path))

    def broken(texts):
        raise OSError("no server")

    ingest(store, papers, blocks, summarize=broken, attempts=1)
    assert {r.error_type for r in store.table("quarantine").collect()} == {"TransientError"} and store.table("state").count() == 0 and store.table("vectors").count() == 0
    ingest(store, papers, blocks)
    assert {r.stage for r in store.table("state").collect()} == {"done"} and store.table("quarantine").count() == 2  # the first reason stays on record


def test_harvest_by_settings_and_prefetch(spark, tmp_path):
    from folioflow.sources.files import cached, sidecars

    entry = "<entry><id>http://arxiv.org/abs/{}</id><title>A</title><summary>s</summary><category term='cs.LG'/><published>2024-01-02T00:00:00Z</published><updated>2024-01-03T00:00:00Z</updated></entry>"
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'>{}</feed>"
    (tmp_path / "topic1-0.xml").write_text(feed.format("".join(entry.format(f"2401.0000{i}v1") for i in range(5))))
    (tmp_path / "ids-0.xml").write_text(feed.format(entry.format("2401.00004v1")))
    got = lambda conf, known=None: sorted(r.paper_id for r in plan.harvested(spark, conf, known, folder=str(tmp_path)).collect())
    known = spark.createDataFrame([("2401.00001",)], "paper_id string")
    assert got(settings(corpus_cap=3), known) == ["2401.00000", "2401.00002"]
    assert got(settings(ingest_paper_ids=["2401.00004"])) == ["2401.00004"]
    refs = plan.harvested(spark, settings(), folder=str(tmp_path))

    def download(urls):
        if any(u.endswith("3") for u in urls):
            raise OSError("404")
        return [b"\x1f\x8bzip" if u.endswith("2") else b"%PDF-" + u.encode() for u in urls]

    none = known.limit(0)
    path = str(tmp_path / "cache")
    failed = plan.prefetched(spark, refs, known, none, none, download, path, attempts=1)
    assert {r.paper_id: (r.error_type, r.error) for r in failed.collect()} == {"2401.00003": ("TransientError", "404"), "2401.00002": ("PermanentError", "gzip")}
    assert {r.paper_id for r in cached(spark, path).collect()} == {r.paper_id for r in sidecars(spark, path).collect()} == {"2401.00000", "2401.00004"}
    assert plan.prefetched(spark, refs, known, cached(spark, path), failed, download, path).count() == 0


def test_headers(spark):
    from folioflow.operators import models

    chunks = spark.createDataFrame([("a", "p", "chunk {a}"), ("b", "p", " "), ("c", "q", "no summary"), ("d", "p", "fails"), ("e", "p", "says nothing"), ("f", "p", "long")], "id string, paper_id string, text string")
    summaries = spark.createDataFrame([("p", "sum {chunk}")], "paper_id string, text string")

    def call(prompts):
        if any("fails" in p for p in prompts):
            raise ValueError("refused")
        return [" " if "nothing" in p else "w " * 500 if "long" in p else f"<{p}>" for p in prompts]

    headers = models.generated_headers(chunks, summaries, call, "S: {summary} C: {chunk}", attempts=1)
    got = {r.id: (r.header, r.error_type, r.error) for r in headers.collect()}
    assert got["a"] == ("<S: sum {chunk} C: chunk {a}>", None, None) and got["b"] == got["c"] == ("", None, None)
    assert got["d"] == (None, "PermanentError", "refused") and got["e"] == (None, "PermanentError", "an empty header") and len(got["f"][0].split()) == models.HEADER_WORDS
    texts = {r.id: r.embed_text for r in models.with_headers(chunks, headers).collect()}
    assert texts["a"] == "<S: sum {chunk} C: chunk {a}>\n\nchunk {a}" and texts["c"] == "no summary" and texts["d"] == "fails"


def test_retry_after(spark):
    from folioflow.functions.dates import retry_after_s

    said = {"120": 120.0, " 0 ": 0.0, "Wed, 21 Oct 2015 07:28:30 GMT": 30.0, "Wed, 21 Oct 2015 07:00:00 GMT": 0.0, "soon": None, "": None, "-5": None}
    rows = spark.createDataFrame([(k,) for k in said] + [(None,)], "h string").select("h", retry_after_s(F.col("h"), F.to_timestamp(F.lit("2015-10-21 07:28:00"))).alias("s"))
    assert {r.h: r.s for r in rows.collect()} == said | {None: None}


def test_holders(spark, monkeypatch):
    import random

    from folioflow.operators import evaluation

    rng = random.Random(6)
    texts = {f"d{i}": " ".join(rng.choices(["aa", "b", "cc", "dd\n", " e", "ünï"], k=rng.randint(0, 40))) for i in range(80)} | {"none": None}
    items = {i: (t := texts[f"d{i % 80}"])[(a := rng.randint(0, max(0, len(t) - 1))) : a + rng.choice([1, 5, 12, 25, 60])] for i in range(120)} | {200: None, 201: "", 202: "not there at all in any of them"}
    want = {(i, d) for i, x in items.items() if x is not None for d, t in texts.items() if t is not None and x in t}
    a, b = spark.createDataFrame(list(items.items()), "item_id int, item string"), spark.createDataFrame(list(texts.items()), "paper_id string, text string")
    for most in (1000, 3):
        monkeypatch.setattr(evaluation, "MOST_NAMED", most)
        found = [tuple(r) for r in evaluation.holders(a, b).collect()]
        assert set(found) == want and len(found) == len(want)
