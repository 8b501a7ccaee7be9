"""Queries over zero, null and odd vectors, held against their SQL."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from folioflow.queries import QUERIES, SQL

DOCUMENTS, QUESTIONS = 400, 12


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """400 short texts; of the vectors every seventh is null, every eleventh zero, one holds a NaN. Questions 0, 7 have a null vector, 11 a zero one."""
    at = str(tmp_path_factory.mktemp("vectors"))
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), pick(k, 30).cast("string")) for k in range(6)])
    docs = spark.range(DOCUMENTS).select(F.col("id").alias("doc_id"), words.alias("text"), F.element_at(F.array(F.lit("en"), F.lit("de")), (pick(7, 2) + 1).cast("int")).alias("lang"), F.concat(F.lit("src"), pick(8, 4).cast("string")).alias("source"))
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{at}/documents.parquet")
    usual = F.array(*[(pick(20 + k, 2001) / 1000 - 1).cast("float") for k in range(8)])
    zeros, odd = (F.array(*[F.lit(x).cast("float")] + [F.lit(0.0).cast("float")] * 7) for x in (0.0, float("nan")))
    vector = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, zeros).when(F.col("id") == 102, odd).otherwise(usual)
    spark.range(DOCUMENTS).select(F.col("id").alias("vec_id"), vector.alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{at}/embeddings.parquet")
    spark.range(0, DOCUMENTS, 4).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    # a question's vector isn't that of the document that holds it
    docs.filter(F.col("doc_id").between(200, 199 + QUESTIONS)).select((F.col("doc_id") - 200).alias("item_id"), "text").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def odd_connection(odd_dir):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd_dir}/{t}.parquet/*.parquet'")
    return c


NAMES = [
    "hybrid_search_filtered",
    "eval_recall_mrr",
    "eval_grouping_sets",
    "orphan_hits",
    "rerank_pool_reverse",
    "retrieve_grounded",
    "retrieve_papers",
    "coverage_counts",
]


@pytest.mark.parametrize("name", NAMES)
def test_odd_vectors_equal_sql(name, spark, odd_connection, odd_dir):
    compare(spark, odd_connection, QUERIES[name], SQL[name], odd_dir)
