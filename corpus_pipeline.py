"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

Each stage works on all that its predecessor kept; `run` writes each stage's rows as Parquet in the
shared folder and reads them again, so that a lost executor never sends a stage back to the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import mixing, ngram_join, packing, quality_rules, secrets
from folioflow.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them. Repeated rows are judged alike; columns stay; an empty table stays empty."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, repeated rows and ties by least id. Null counts as empty text; columns stay; an empty table stays empty."""
    return ngram_join.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to the names of their kinds; every document stays, null and empty texts as they are, long ones searched whole. Columns stay; an empty table stays empty."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, in the order of the mixture; a null source is one of its own, rows of equal id lie side by side. Columns stay; an empty table stays empty."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences, numbered in the order of the mixture.

    Null and empty texts are an end id alone; texts of any length are packed whole; an empty table gives no piece. Files are not read in the order in which they were written, so the rows are placed anew. Places are written before
    rows move by them, so that a task that is run again packs the same rows.
    """
    mix = written(mixing.placed(docs.select("doc_id", "text", "source")), "mix-placed")
    return packing.pack(mix.repartitionByRange("mix.position").sortWithinPartitions("mix.position"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("packing", packed),
]

#: The estimates, MinHash pruning and tokenizing are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"stage{n}")
    return docs
