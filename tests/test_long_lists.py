"""Queries over lists of more than 10,000 rows, held against their SQL."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from folioflow.operators import search
from folioflow.operators.fusion import ranked, rrf
from folioflow.queries import QUERIES, SQL

DOCUMENTS, QUESTIONS = 60_000, 12


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """60,000 short texts, 12,000 of them summaries, each with a vector."""
    at = str(tmp_path_factory.mktemp("long"))
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), pick(k, 30).cast("string")) for k in range(6)])
    docs = spark.range(DOCUMENTS).select(F.col("id").alias("doc_id"), words.alias("text"), F.element_at(F.array(F.lit("en"), F.lit("de")), (pick(7, 2) + 1).cast("int")).alias("lang"), F.concat(F.lit("src"), pick(8, 4).cast("string")).alias("source"))
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{at}/documents.parquet")
    spark.range(DOCUMENTS).select(F.col("id").alias("vec_id"), F.array(*[(pick(20 + k, 2001) / 1000 - 1).cast("float") for k in range(8)]).alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{at}/embeddings.parquet")
    spark.range(0, DOCUMENTS, 4).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    docs.filter(F.col("doc_id") < QUESTIONS).select(F.col("doc_id").alias("item_id"), F.substring_index("text", " ", 3).alias("text")).write.parquet(f"{at}/benchmark.parquet")
    return at


def _connect(at):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return c


@pytest.fixture(scope="module")
def long_connection(long_dir):
    return _connect(long_dir)


@pytest.fixture(scope="module")
def many_dir(spark, long_dir, tmp_path_factory):
    """The same tables with 90 questions."""
    at = tmp_path_factory.mktemp("many")
    for t in ("documents", "embeddings", "labels"):
        (at / f"{t}.parquet").symlink_to(f"{long_dir}/{t}.parquet")
    docs = spark.read.parquet(f"{long_dir}/documents.parquet").filter("doc_id < 90")
    docs.select(F.col("doc_id").alias("item_id"), F.substring_index("text", " ", 3).alias("text")).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def many_connection(many_dir):
    return _connect(many_dir)


NAMES = [
    "retrieve_grounded",
    "rerank_pool_reverse",
    "hybrid_search_filtered",
    "rrf_fusion",
]
OF_MANY = [
    "orphan_hits",
    "coverage_counts",
    "eval_grouping_sets",
    "eval_recall_mrr",
    "retrieve_papers",
]


@pytest.mark.parametrize("name", OF_MANY)
def test_long_lists_of_many_questions_equal_sql(name, spark, many_connection, many_dir):
    compare(spark, many_connection, QUERIES[name], SQL[name], many_dir)


@pytest.mark.parametrize("name", NAMES)
def test_long_lists_equal_sql(name, spark, long_connection, long_dir):
    compare(spark, long_connection, QUERIES[name], SQL[name], long_dir)


def test_channels_rank_every_row(spark):
    rows = spark.range(10_050).select("id", F.array(F.lit(1.0), F.col("id") / 10_000).alias("embedding"), F.when(F.col("id") == 0, "a b").otherwise("a").alias("text"))
    asked = spark.createDataFrame([(1, "a b", [0.0, 1.0])], "query_id int, text string, vector array<double>")
    dense, sparse = search.dense(rows, asked), search.sparse(search.overlap_scores(rows, asked))
    assert dense.count() == sparse.count() == 10_050
    assert dense.filter("id = 0").first()["rank"] == 10_050
    assert rrf(dense, sparse, 0.5, by=["query_id"]).filter("id = 0").first().score == pytest.approx(0.5 / 10_110 + 0.5 / 61, abs=1e-15)


def test_ranks_by_stretches_of_scores(spark):
    df = spark.range(3_000).select((F.col("id") % 2).alias("q"), "id", ((F.col("id") * 7919 % 500) / 100 - 2).alias("score"))
    for q in (0, 1):
        want = [(r.id, n) for n, r in enumerate(sorted(df.filter(f"q = {q}").collect(), key=lambda r: (-r.score, r.id)), 1)]
        assert [(r.id, r["rank"]) for r in ranked(df, ["q"]).filter(f"q = {q}").orderBy("rank").collect()] == want


def test_copies_of_a_vector_score_alike_to_the_last_bit(spark):
    v = F.array(*[F.lit(((k * 37) % 101 - 50) / 77) for k in range(64)])
    rows = spark.range(1_037).select("id", v.alias("embedding"))
    asked = spark.range(7).select(F.col("id").alias("query_id"), F.array(*[F.lit(((k * 53) % 97 - 40) / 31) + F.col("id") for k in range(64)]).alias("vector"))
    got = search.dense(rows, asked)
    assert got.groupBy("query_id").agg(F.count_distinct("score").alias("n")).filter("n > 1").count() == 0
    assert got.filter("rank <> id + 1").count() == 0
