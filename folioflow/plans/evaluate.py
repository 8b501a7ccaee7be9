"""Evaluation of a store: all questions in one search, ranks of their gold results, a report as files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators import evaluation, models, retrieval, search
from folioflow.operators.search import Filters
from folioflow.plans.ingest import Store
from folioflow.sinks.commits import write_file
from folioflow.sinks.scratch import filesystem, kept

#: Questions whose rows go into the report itself; those of more are in its folder alone.
MOST_ROWS = 1000


def evaluated(store: Store, questions: DataFrame, k: int = retrieval.DEFAULT_K, embed: Callable | None = None, rerank: Callable | None = None, weight: float = 0.5, depth: int = retrieval.POOL, attempts: int = 3) -> DataFrame:
    """question_id, question_type, gold_paper_ids, gold_block_id, paper_rank, passage_rank, passage_scored, error of every question.

    questions: question_id, question_type, text, gold_paper_ids, gold_block_id. They are searched together, as `Tools.semantic_search` does one. A
    question that the embedder refuses, or gives a vector of another length than the store's, keeps its error and has no ranks; the others go on.
    """
    now = store.here()
    vectors, dim = now.table("vectors"), now.dimension() or models.DIM
    vector = models.guarded(models.unit_vectors(embed or models.fake_vectors), attempts, value=T.ArrayType(T.DoubleType()))
    asked = kept(questions.withColumn("r", vector("text")), "asked")
    fits = F.col("r.ok") & (F.size("r.value") == dim)
    error = F.when(~F.col("r.ok"), F.col("r.error")).when(~fits, F.concat(F.lit("a vector of "), F.size("r.value").cast("string"), F.lit(f" instead of {dim}")))
    good = asked.filter(fits).select(F.col("question_id").alias("query_id"), "text", F.col("r.value").alias("vector"))
    pool_size = retrieval.pool_size(k, depth)
    pool = search.hybrid(vectors, good, Filters(kind="chunk"), weight, pool_size, terms=now.table("terms"))
    if rerank is not None:
        texts = pool.join(vectors.select("id", "text"), "id").join(good.select("query_id", F.col("text").alias("question")), "query_id")
        pool = retrieval.reranked(texts.withColumn("relevance", models.reranker(rerank)("question", "text")).drop("text", "question"), F.col("relevance"), pool_size)
    chunks = now.table("chunks").select("chunk_id", "paper_id", F.col("anchor.block_id").alias("block_id"), "text")
    found = retrieval.grounded(pool, chunks, now.table("papers").select("paper_id", "title"), now.table("blocks"), k, good.count() * pool_size)
    results = found.select(F.col("query_id").alias("question_id"), F.col("place").alias("rank"), "paper_id", "block_id")
    gold = asked.select("question_id", "question_type", "gold_paper_ids", "gold_block_id", error.alias("error"))
    ranks = evaluation.first_ranks(gold, results, k).drop("question_type")
    return gold.join(ranks, "question_id").select("question_id", "question_type", "gold_paper_ids", "gold_block_id", "paper_rank", "passage_rank", "passage_scored", "error")


def question_rows(ranks: DataFrame) -> DataFrame:
    """One row a question as the report has it, so that two reports tell which questions moved."""
    level = lambda c: (F.col(c).isNotNull().alias("hit"), F.col(c).alias("rank"))
    return ranks.select("question_id", "question_type", F.array_sort("gold_paper_ids").alias("gold_paper_ids"), "gold_block_id", "error", F.struct(*level("paper_rank")).alias("paper_level"), F.struct(F.col("passage_scored").alias("scored"), *level("passage_rank")).alias("passage_level"))


def report(ranks: DataFrame, k: int, per_question: bool = True) -> dict:
    """Recall and mean reciprocal rank by papers and passages, over all and by type of question; null figures where there is none."""
    none = {"recall_at_k": None, "mrr": None, "n": 0}
    out = {"k": k, "n_questions": 0, "n_errors": 0, "paper_level": {"overall": none, "by_question_type": {}}, "passage_level": {"n_scored": 0, "overall": none, "by_question_type": {}}}
    totals = ranks.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("passage_scored").alias("scored")).first()
    out["n_questions"], out["n_errors"], out["passage_level"]["n_scored"] = totals.n, totals.errors, totals.scored
    for r in evaluation.report(ranks).orderBy("level", "overall", "question_type").collect():  # a row for each type of question
        if r.n:
            figures, level = {"recall_at_k": r.recall, "mrr": r.mrr, "n": r.n}, out[f"{r.level}_level"]
            if r.overall:
                level["overall"] = figures
            else:
                level["by_question_type"][r.question_type] = figures
    if per_question and totals.n <= MOST_ROWS:
        out["questions"] = [json.loads(r.value) for r in question_rows(ranks).orderBy("question_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect()]
    return out


def write(ranks: DataFrame, k: int, path: str, per_question: bool = True) -> dict:
    """The report as path/report.json and, with `per_question`, a JSON line for each question under path/questions; in the place of an older one."""
    spark = ranks.sparkSession
    ranks = kept(ranks, "ranks")
    out = report(ranks, k, per_question)
    if per_question:
        question_rows(ranks).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/questions")
    fs, old = filesystem(spark, f"{path}/report.json")
    fs.delete(old, False)
    write_file(spark, f"{path}/report.json", json.dumps(out, indent=2))
    return out


def summary(out: dict) -> str:
    """A report in a few lines."""

    def said(m: dict) -> str:
        return f"Recall@{out['k']}={m['recall_at_k']:.3f} MRR={m['mrr']:.3f} (n={m['n']})" if m["n"] else "n=0"

    lines = [f"{out['n_questions']} questions, {out['n_errors']} errors"]
    for level in ("paper_level", "passage_level"):
        lines.append(f"{level}: {said(out[level]['overall'])}")
        lines += [f"  {kind}: {said(m)}" for kind, m in sorted(out[level]["by_question_type"].items())]
    return "\n".join(lines)
