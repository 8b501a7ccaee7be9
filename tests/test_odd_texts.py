"""Queries over texts with odd characters, held against their SQL."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from folioflow.functions.text import lower, tokens
from folioflow.queries import QUERIES, SQL

DOCUMENTS, QUESTIONS = 400, 12


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """400 short texts; words of the questions are in many of them in another case, or with a vertical tab between them."""
    at = str(tmp_path_factory.mktemp("odd"))
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    several = F.array(*map(F.lit, ["ΟΔΟΣ", "οδοσ", "οδος", "İzmir", "izmir", "a\x0bb", "b", "Ɤx", "ɤx"]))
    odd = lambda k: F.element_at(several, (pick(k, 9) + 1).cast("int"))
    plain = [F.concat(F.lit("w"), pick(k, 9).cast("string")) for k in range(2)]
    docs = spark.range(DOCUMENTS).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *plain, odd(5), odd(6)).alias("text"), F.element_at(F.array(F.lit("en"), F.lit("de")), (pick(7, 2) + 1).cast("int")).alias("lang"), F.concat(F.lit("src"), pick(8, 4).cast("string")).alias("source"))
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{at}/documents.parquet")
    spark.range(DOCUMENTS).select(F.col("id").alias("vec_id"), F.array(*[(pick(20 + k, 2001) / 1000 - 1).cast("float") for k in range(8)]).alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{at}/embeddings.parquet")
    spark.range(0, DOCUMENTS, 4).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    # a question's vector isn't that of the document that holds it
    docs.filter(F.col("doc_id").between(200, 199 + QUESTIONS)).select((F.col("doc_id") - 200).alias("item_id"), "text").write.parquet(f"{at}/benchmark.parquet")
    return at


def _connect(at):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return c


@pytest.fixture(scope="module")
def odd_connection(odd_dir):
    return _connect(odd_dir)


@pytest.fixture(scope="module")
def null_dir(spark, odd_dir, tmp_path_factory):
    """The same tables with all texts null but every nineteenth."""
    at = tmp_path_factory.mktemp("null")
    for t in ("embeddings", "labels", "benchmark"):
        (at / f"{t}.parquet").symlink_to(f"{odd_dir}/{t}.parquet")
    spark.read.parquet(f"{odd_dir}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 19 == 0, F.col("text"))).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.fixture(scope="module")
def null_connection(null_dir):
    return _connect(null_dir)


NAMES = [
    "retrieve_papers",
    "retrieve_grounded",
    "orphan_hits",
    "hybrid_search_filtered",
    "eval_recall_mrr",
    "eval_grouping_sets",
    "rerank_pool_reverse",
]


OF_NULLS = [
    "retrieve_papers",
    "retrieve_grounded",
    "coverage_counts",
]


@pytest.mark.parametrize("name", OF_NULLS)
def test_null_texts_equal_sql(name, spark, null_connection, null_dir):
    compare(spark, null_connection, QUERIES[name], SQL[name], null_dir)


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts_equal_sql(name, spark, odd_connection, odd_dir):
    compare(spark, odd_connection, QUERIES[name], SQL[name], odd_dir)


def test_lower_case_by_character(spark):
    said = "ΟΔΟΣ ΑΣ. İßᲉÄꟋꟌꟚꟜA\U00010d50\U00010d65Z"
    row = spark.createDataFrame([(said, "ABC Ä", None)], "a string, b string, c string").select(*[lower(F.col(c)).alias(c) for c in "abc"]).first()
    assert row.a == "οδοσ ασ. ißᲉäꟋꟌꟚꟜa\U00010d50\U00010d65z"
    assert (row.b, row.c) == ("abc ä", None)


def test_a_vertical_tab_is_part_of_a_word(spark):
    assert spark.createDataFrame([("A\x0bB\fc\x1cd e\xa0f",)], "t string").select(tokens(F.col("t"))).first()[0] == ["a\x0bb", "c", "d", "e", "f"]
