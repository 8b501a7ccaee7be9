"""A Markdown note for each paper, and an index of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import slug, tag

TAG = "paper"
#: The last section of a note, and the index's title.
CLAIMS = "\n## Claims\n\n_Not yet generated -- deferred to the claim-layer V1 ticket._\n"
INDEX = "# Papers Index"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def _list(items: Column) -> Column:
    return F.when(F.size(items) == 0, " []").otherwise(F.concat(F.lit("\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), _quoted(x))), "\n")))


def rendered(papers: DataFrame) -> DataFrame:
    """paper_id, file, note of papers (paper_id, version, title, authors, categories, published, pdf_url, summary, sections)."""
    day = F.col("published").cast("string")
    front = F.concat(
        F.lit("---\ntitle: "), _quoted(F.col("title")), F.lit("\narxiv_id: "), F.col("paper_id"), F.col("version"), F.lit("\nauthors:"), _list(F.col("authors")), F.lit("\ncategories:"), _list(F.col("categories")),
        F.lit("\npublished: "), _quoted(day), F.lit("\ntags:"), _list(F.concat(F.array(F.lit(TAG)), F.transform("categories", tag))), F.lit("\n---\n"),
    )
    authors = F.when(F.size("authors") == 0, "(none listed)").otherwise(F.array_join(F.transform("authors", lambda a: F.concat(F.lit("[["), a, F.lit("]]"))), ", "))
    sections = F.filter(F.coalesce("sections", F.array().cast("array<string>")), lambda s: s != "")
    body = F.concat(
        F.lit("\n# "), F.col("title"), F.lit("\n\n**Authors:** "), authors, F.lit("\n**Published:** "), day, F.lit("\n**Source:** [PDF]("), F.col("pdf_url"), F.lit(") · [arXiv](https://arxiv.org/abs/"), F.col("paper_id"), F.lit(")\n\n## Summary\n\n"),
        F.coalesce(F.nullif("summary", F.lit("")), F.lit("_(no summary stored)_")), F.lit("\n"),
        F.when(F.size(sections) > 0, F.concat(F.lit("\n## Sections\n\n"), F.array_join(F.transform(sections, lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("\n"))).otherwise(""),
        F.lit(CLAIMS),
    )
    return papers.select("paper_id", F.concat(slug(F.col("paper_id")), F.lit(".md")).alias("file"), F.concat(front, body).alias("note"))


def index(papers: DataFrame) -> DataFrame:
    """value: the index's lines, its title and the number of papers, then the newest papers first."""
    line = F.concat(F.lit("- [["), slug(F.col("paper_id")), F.lit("|"), F.col("title"), F.lit("]] ("), F.col("published").cast("string"), F.lit(")"))
    head = papers.agg(F.count("*").alias("n")).select(F.posexplode(F.array(F.lit(INDEX), F.lit(""), F.concat(F.col("n").cast("string"), F.lit(" papers.")), F.lit(""))).alias("at", "value"))
    lines = head.select("at", F.lit(None).cast("date").alias("published"), F.lit(None).cast("string").alias("paper_id"), "value")
    lines = lines.unionByName(papers.select(F.lit(9).alias("at"), F.col("published").cast("date").alias("published"), "paper_id", line.alias("value")))
    return lines.orderBy("at", F.desc("published"), F.desc("paper_id")).select("value")


def export(papers: DataFrame, path: str) -> None:
    """Notes as files path/notes/<slug>.md, one a paper, each whole or not there, and the index under path/index."""
    from folioflow.sinks.file_rows import save

    save(rendered(papers).select("file", F.col("note").alias("value")), f"{path}/notes")
    index(papers).write.mode("overwrite").text(f"{path}/index")
