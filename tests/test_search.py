from datetime import date

import pytest
from pyspark.sql import functions as F

from folioflow.operators import retrieval, search
from folioflow.operators.fusion import ranked, rrf
from folioflow.operators.search import Filters

SCHEMA = "id string, kind string, paper_id string, text string, section_path string, categories array<string>, published date, embedding array<double>"


@pytest.fixture(scope="module")
def points(spark):
    day = date(2024, 5, 1)
    return spark.createDataFrame(
        [
            ("winner", "chunk", "p1", "method estimator", "S", ["stat.ME"], day, [1.0, 0.0]),
            ("dense_only", "chunk", "p2", "unrelated header", "S", ["cs.LG"], date(2024, 6, 1), [1.0, 0.0]),
            ("sparse_only", "chunk", "p3", "method estimator", "S", ["stat.ME"], day, [0.0, 1.0]),
            ("noise", "summary", "p4", "acknowledgements", "", ["cs.LG"], day, [0.0, 0.0]),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def question(spark):
    return spark.createDataFrame([(1, "Method  estimator", [1.0, 0.0])], "query_id int, text string, vector array<double>")


@pytest.mark.parametrize("channel", ["overlap", "tfidf"])
def test_a_hit_in_both_channels_wins(points, question, channel):
    got = search.hybrid(points, question, channel=channel).orderBy("rank").collect()
    assert got[0].id == "winner"
    assert {r.id for r in got} == {"winner", "dense_only", "sparse_only", "noise"}


def test_zero_vector_scores_zero_and_ties_go_by_id(points, question):
    got = search.dense(points, question).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("dense_only", 1.0), ("winner", 1.0), ("noise", 0.0), ("sparse_only", 0.0)]


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        (Filters(categories=("stat.ME",)), {"winner", "sparse_only"}),
        (Filters(categories=()), set()),
        (Filters(kind="summary"), {"noise"}),
        (Filters(published_after=date(2024, 5, 1), published_before=date(2024, 5, 1)), {"winner", "sparse_only", "noise"}),
        (Filters(published_after=date(2024, 5, 2)), {"dense_only"}),
    ],
)
def test_filters(points, filters, ids):
    assert {r.id for r in search.filtered(points, filters).collect()} == ids


def test_kind_and_date_filters_reach_the_scan(points, tmp_path, spark):
    points.write.parquet(f"{tmp_path}/p")
    plan = search.filtered(spark.read.parquet(f"{tmp_path}/p"), Filters(kind="chunk", published_after=date(2024, 1, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,chunk)" in plan and "GreaterThanOrEqual(published" in plan


def lists(spark, rows):
    return spark.createDataFrame(rows, "id string, rank int")


def test_fusion_numbers(spark):
    got = {r.id: r.score for r in rrf(lists(spark, [("a", 1), ("b", 2)]), lists(spark, [("a", 1), ("c", 1)]), 0.5).collect()}
    assert got["a"] == pytest.approx(1 / 61)
    assert got["b"] == pytest.approx(0.5 / 62)
    assert got["c"] == pytest.approx(0.5 / 61)


@pytest.mark.parametrize(("w", "k"), [(-0.1, 60), (1.1, 60), (0.5, 0)])
def test_fusion_refuses(spark, w, k):
    with pytest.raises(ValueError):
        rrf(lists(spark, []), lists(spark, []), w, k)


def test_fusion_refuses_an_id_twice(spark):
    with pytest.raises(Exception, match="twice"):
        rrf(lists(spark, [("a", 1), ("a", 2)]), lists(spark, [("b", 1)])).collect()


def test_rerank_keeps_the_fused_score_and_breaks_ties_by_place(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1, 5.0), (1, "b", 0.8, 2, 7.0), (1, "c", 0.7, 3, 7.0)], "query_id int, id string, score double, rank int, relevance double")
    got = retrieval.reranked(hits, F.col("relevance")).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("b", 0.8), ("c", 0.7), ("a", 0.9)]
    assert [r.id for r in retrieval.reranked(hits).orderBy("rank").collect()] == ["c", "b", "a"]
    assert [r.id for r in retrieval.reranked(hits, depth=2).orderBy("rank").collect()] == ["b", "a"]


def test_orphans_drop_before_the_cut(spark):
    hits = spark.createDataFrame([(1, "gone", 0.9, 1), (1, "c1", 0.8, 2), (1, "c2", 0.7, 3)], "query_id int, id string, score double, rank int")
    chunks = spark.createDataFrame([("c1", "p", "b1", "one"), ("c2", "p", "b2", "two")], "chunk_id string, paper_id string, block_id string, text string")
    papers = spark.createDataFrame([("p", "T")], "paper_id string, title string")
    blocks = spark.createDataFrame([("b1", "S1", "x"), ("b2", "S2", "y")], "block_id string, section_path string, text string")
    got = retrieval.grounded(hits, chunks, papers, blocks, 2).orderBy("place").collect()
    assert [(r.id, r.place, r.section_path) for r in got] == [("c1", 1, "S1"), ("c2", 2, "S2")]
    assert [r.id for r in retrieval.orphans(hits, chunks).collect()] == ["gone"]
    with pytest.raises(Exception, match="block is missing"):
        retrieval.grounded(hits, chunks, papers, blocks.filter("block_id = 'b1'"), 2).collect()


def test_bounds():
    assert [retrieval.clamp_k(k) for k in (None, -3, 7, 1000)] == [10, 1, 7, 100]
    assert [retrieval.pool_size(k) for k in (5, 40)] == [32, 40]


def test_ranked_limits_each_list(spark):
    df = spark.createDataFrame([("q", i, float(i % 3)) for i in range(9)], "q string, id int, score double")
    assert [r.id for r in ranked(df, most=2).orderBy("rank").collect()] == [2, 5]


def test_request_filters():
    f = search.request_filters("a, b,", "20240102", "never")
    assert f == Filters(("a", "b"), date(2024, 1, 2), None)
    assert search.request_filters() == Filters()
    with pytest.raises(ValueError):
        search.request_filters(None, "2024-02-01", "2024-01-01")
