"""Stores that change, vector lists and posting blocks over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import vector_index
from folioflow.operators.postings import Postings
from folioflow.queries.retrieval import questions
from folioflow.queries.views import BLOCKS, COLLECTION, QUESTIONS, tokens, with_
from folioflow.sinks.commits import Tables, rebuild
from folioflow.sinks.scratch import folder
from folioflow.sources import tables
from folioflow.sources.tables import table


def _tables(spark: SparkSession) -> Tables:
    return Tables(spark, f"{folder(spark)}/tables-{uuid.uuid4().hex}")


def store_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers and their blocks after commits that put them, replace those of one language, delete toxic papers and single blocks by keys, and a verified rebuild."""
    t = _tables(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "lang", F.length("text").cast("long").alias("size"))
    blocks = tables.blocks(spark, sf_dir).select("block_id", "paper_id", "type")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("paper_id")).distinct()
    with t.change() as c:
        c.put("papers", d)
        c.put("blocks", blocks)
    with t.change() as c:
        french = d.filter("lang = 'fr'")
        c.put("papers", french.withColumn("size", -F.col("size")))
        c.put("blocks", blocks.join(french, "paper_id", "left_semi").filter("type <> 'code'"), keys=french)
    with t.change() as c:
        c.delete("papers", toxic)
        c.delete("blocks", toxic)
        c.delete("blocks", blocks.filter("type = 'caption'"), "block_id")
    rebuild(t, "blocks")
    n = t.read("blocks").groupBy("paper_id").agg(F.count("*").alias("n_blocks"))
    return t.read("papers").join(n, "paper_id", "left").select("paper_id", "lang", "size", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those of ids that twenty divides as questions."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return e, e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def _ivf(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    index = vector_index.build(e, f"{folder(spark)}/lists-{uuid.uuid4().hex}")
    probe = None if exact else vector_index.probes_for(index, q)
    return vector_index.topk(index, q, 10, probe).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of each question from the lists that it is sent to, as many as a sample of questions needs."""
    return _ivf(spark, sf_dir, False)


def ivf_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from all lists of the index."""
    return _ivf(spark, sf_dir, True)


def blockmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF from posting blocks of two segments, those blocks alone that can reach a question's list."""
    p, c = Postings(_tables(spark)), tables.collection(spark, sf_dir).select("id", "text")
    p.add(c.filter("id % 3 = 0"))
    p.add(c.filter("id % 3 <> 0"))
    found, _ = p.topk(questions(spark, sf_dir), 20)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def blockmax_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after some texts were cut to their first words and the summaries removed: counts go by what each change adds and takes away."""
    p, c = Postings(_tables(spark)), tables.collection(spark, sf_dir).select("id", "kind", "text")
    p.add(c)
    p.add(c.filter("id % 7 = 0").select("id", F.substring_index("text", " ", 40).alias("text")))
    p.remove(c.filter("kind = 'summary'"))
    found, _ = p.topk(questions(spark, sf_dir), 20)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (store_after_delete, ivf_topk, ivf_exact_topk, blockmax_topk, blockmax_after_change)}

_TFIDF = (
    f"terms AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({tokens('text')}) AS token FROM searched) GROUP BY ALL)",
    f"asked AS (SELECT query_id, token, count(*) AS asked FROM (SELECT query_id, unnest({tokens('text')}) AS token FROM questions) GROUP BY ALL)",
    "idf AS (SELECT token, ln(((SELECT count(*) FROM searched) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM terms GROUP BY 1)",
    "scored AS (SELECT query_id, id, round(sum(tf * asked * idf), 9) AS score FROM terms JOIN asked USING (token) JOIN idf USING (token) GROUP BY ALL)",
)
_TOP = "SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"
_WIDE = "cast(embedding AS DOUBLE[])"

SQL = {
    "store_after_delete": with_(
        BLOCKS,
        "toxic AS (SELECT DISTINCT cast(doc_id AS VARCHAR) AS paper_id FROM labels WHERE toxic = 1)",
        "p AS (SELECT cast(doc_id AS VARCHAR) AS paper_id, lang, length(text) AS size FROM documents)",
        "n AS (SELECT paper_id, count(*) AS n_blocks FROM blocks JOIN p USING (paper_id) WHERE type <> 'caption' AND NOT (lang = 'fr' AND type = 'code') GROUP BY 1)",
    )
    + "SELECT paper_id, lang, CASE WHEN lang = 'fr' THEN -size ELSE size END AS size, coalesce(n_blocks, 0) AS n_blocks FROM p LEFT JOIN n USING (paper_id) ANTI JOIN toxic USING (paper_id)",
    "ivf_exact_topk": f"""WITH q AS (SELECT vec_id AS query_id, {_WIDE} AS v FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id AS id, {_WIDE} AS x FROM embeddings),
scored AS (SELECT query_id, id, round(list_dot_product(x, v) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(v, v))), 9) AS score FROM e, q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10""",
    "blockmax_topk": with_(COLLECTION, QUESTIONS, "searched AS (SELECT id, text FROM collection)", *_TFIDF) + _TOP,
    "blockmax_after_change": with_(COLLECTION, QUESTIONS, "searched AS (SELECT id, CASE WHEN id % 7 = 0 THEN array_to_string(string_split(text, ' ')[1:40], ' ') ELSE text END AS text FROM collection WHERE kind <> 'summary')", *_TFIDF) + _TOP,
}
