"""Typed readers, and views that give the test tables the engine's shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_TYPES = ("prose", "equation", "code", "table", "caption")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def published(doc_id: Column) -> Column:
    return F.date_add(F.lit("2020-01-01").cast("date"), (doc_id % 1500).cast("int"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("paper_id"), F.substring_index("text", "\n", 1).alias("title"), F.array("lang", "source").alias("categories"), published(F.col("doc_id")).alias("published"), F.col("text").alias("markdown"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; a new section every third line, types in turn."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    kind = F.element_at(F.array(*map(F.lit, BLOCK_TYPES)), F.col("idx") % 5 + 1)
    return d.select(F.concat_ws(":b", "paper_id", F.col("idx").cast("string")).alias("block_id"), "paper_id", "idx", kind.alias("type"), "text", F.lit(0).alias("page"), F.concat(F.lit("S"), F.expr("idx div 3").cast("string")).alias("section_path"))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the document of the same number; every fifth stands for a summary."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    j = e.join(d, e["vec_id"] == d["doc_id"])
    return j.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 == 0, "summary").otherwise("chunk").alias("kind"), F.col("doc_id").cast("string").alias("paper_id"), "text", F.array("lang", "source").alias("categories"), published(F.col("doc_id")).alias("published"), "embedding")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user that isn't an error: paper_id, stage, updated_at."""
    from folioflow.operators.state import STAGES

    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    last = e.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("ts").alias("updated_at"))
    return last.select(F.col("user_id").cast("string").alias("paper_id"), F.element_at(F.array(*map(F.lit, STAGES)), F.floor(F.col("value")).cast("int") % 7 + 1).alias("stage"), "updated_at")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors: paper_id, ts, error."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.col("user_id").cast("string").alias("paper_id"), "ts", F.col("props").alias("error"), "event_id")
