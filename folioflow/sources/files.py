"""Files: logs, caches, references with sidecars, question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event string, run_id string, ts double, stage string, paper_count bigint, n_done bigint, n_quarantined bigint, wall_clock_s double"
REF = "paper_id string, version string, title string, abstract string, authors array<string>, categories array<string>, published date, updated date, pdf_url string, latex_url string"
TRUTH = "question_id string, question_text string, question_type string, difficulty string, source_paper_id string, additional_gold_paper_ids array<string>, gold_block_id string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A run log of JSON lines; lines that aren't JSON objects are skipped. line_no grows with the place in the file."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    e = lines.select("line_no", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).filter("e.event IS NOT NULL")
    return e.select("line_no", "e.*")


def references(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of paper references."""
    return spark.read.schema(REF).json(path, multiLine=True)


def cached(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """paper_id, bytes of the files with the suffix; contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path)
    return f.select(F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1).alias("paper_id"), F.col("length").alias("bytes"))


def cache(papers: DataFrame, path: str) -> None:
    """PDFs (paper_id, content, and the fields of REF) as path/<paper_id>.pdf, then their references as path/<paper_id>.json: a sidecar has its PDF, wherever this stops."""
    from folioflow.sinks.file_rows import save

    save(papers.select(F.concat("paper_id", F.lit(".pdf")).alias("file"), F.col("content").alias("value")), path)
    fields = [f.split()[0] for f in REF.split(", ")]
    save(papers.select(F.concat("paper_id", F.lit(".json")).alias("file"), F.to_json(F.struct(*[f for f in fields if f in papers.columns])).alias("value")), path)


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """The references beside cached PDFs."""
    return spark.read.schema(REF).option("pathGlobFilter", "*.json").json(path)


def cache_totals(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    return cached(spark, path, suffix).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def sidecar_first(wanted: DataFrame, pdfs: DataFrame, sidecars: DataFrame, fetched: DataFrame) -> DataFrame:
    """References of `wanted` (pos, paper_id): fetched ones before those cached with both a PDF and a sidecar, in order."""
    local = sidecars.join(pdfs.select("paper_id"), "paper_id", "left_semi")
    both = fetched.unionByName(local.join(fetched, "paper_id", "left_anti"), allowMissingColumns=True)
    return wanted.join(both, "paper_id").orderBy("pos")


def to_fetch(wanted: DataFrame, pdfs: DataFrame, sidecars: DataFrame) -> DataFrame:
    return wanted.join(sidecars.join(pdfs.select("paper_id"), "paper_id", "left_semi"), "paper_id", "left_anti")


def last_match(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """value: the pattern's first group in the last line of a log that matches."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).filter(F.col("value").rlike(pattern))
    return lines.agg(F.max_by(F.regexp_extract("value", pattern, 1), "n").alias("value"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).json(path, multiLine=True)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, markdown of one file each."""
    t = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return t.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("paper_id"), F.col("value").alias("markdown"))


def with_markdown(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """`papers` (paper_id, ...) with their markdown; a paper whose text isn't there is an error, named when its row is read."""
    j = papers.join(texts.select("paper_id", F.col("markdown"), F.lit(True).alias("__there")), "paper_id", "left")
    missing = F.raise_error(F.concat(F.lit("no text of paper "), F.col("paper_id"))).cast("string")
    return j.select(*[papers[c] for c in papers.columns], F.when(F.col("__there"), F.col("markdown")).otherwise(missing).alias("markdown"))


def append_event(spark: SparkSession, path: str, **fields) -> None:
    """One more line of the log."""
    names = [f.split()[0] for f in EVENT.split(", ")]
    spark.createDataFrame([tuple(fields.get(n) for n in names)], EVENT).coalesce(1).write.mode("append").json(path)


def append_decisions(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)
