"""Command line: python -m folioflow {query,harvest,ingest,build,eval,search,papers,paper,span,delete,export,snapshot,vacuum,integrity,funnel,failures} ..."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.config import load
from folioflow.functions.dates import compact_date
from folioflow.operators.search import Filters
from folioflow.session import session

TABLES = ("papers", "blocks", "chunks", "summaries", "vectors", "state", "quarantine")


def _callable(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow")
    p.add_argument("--store", default="store")
    p.add_argument("--settings", help="a YAML file")
    p.add_argument("--embed", type=_callable, help="package.module:name of a model's callable")
    p.add_argument("--rerank", type=_callable)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="a registered query over the test tables")
    q.add_argument("name")
    q.add_argument("tables")
    i = sub.add_parser("ingest", help="Parquet of papers and of their blocks")
    i.add_argument("papers")
    i.add_argument("blocks")
    i.add_argument("--topic", nargs="*")
    i.add_argument("--summarize", type=_callable)
    h = sub.add_parser("harvest", help="references that the settings ask for, as Parquet")
    h.add_argument("path")
    h.add_argument("--fetch", help="package.module:name, or /path/file.py:name, of the feed's client")
    h.add_argument("--folder", help="pages of the feed as files")
    b = sub.add_parser("build", help="ingest batches of Parquet of papers and blocks until a target is done")
    b.add_argument("papers")
    b.add_argument("blocks")
    b.add_argument("--target", type=int)
    b.add_argument("--batch", type=int, default=500)
    b.add_argument("--summarize", type=_callable)
    v = sub.add_parser("eval", help="recall and reciprocal ranks of questions with gold results")
    v.add_argument("truth", help="a JSON array of questions")
    v.add_argument("--blind", help="a JSON array of question texts")
    v.add_argument("-k", type=int, default=10)
    v.add_argument("--report", help="a folder for the report")
    v.add_argument("--limit", type=int, help="the first questions alone")
    v.add_argument("--no-per-question", action="store_true")
    for name in ("search", "papers"):
        s = sub.add_parser(name)
        s.add_argument("text")
        s.add_argument("-k", type=int)
        s.add_argument("--categories", type=lambda x: tuple(filter(None, x.split(","))) or None)
        s.add_argument("--after", type=compact_date)
        s.add_argument("--before", type=compact_date)
        s.add_argument("--json", action="store_true", help="one JSON object a line")
    for name in ("paper", "span"):
        sub.add_parser(name).add_argument("id")
    sub.add_parser("delete").add_argument("ids", nargs="+")
    e = sub.add_parser("export", help="notes and index")
    e.add_argument("path")
    e.add_argument("--limit", type=int)
    n = sub.add_parser("snapshot")
    n.add_argument("path")
    n.add_argument("--keep", type=int, default=5)
    v = sub.add_parser("vacuum", help="remove commits but the newest, and what none of them names")
    v.add_argument("--keep", type=int, default=8)
    for name in ("integrity", "funnel", "failures"):
        sub.add_parser(name)
    return p


def as_json(rows: DataFrame) -> list[str]:
    return [json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in rows.collect()]


def _shown(rows: DataFrame, most: int) -> None:
    """The first rows, and how many there are."""
    rows.show(most, truncate=False)
    n = rows.count()
    print(f"{n} rows" + (f", {n - most} not shown" if n > most else ""))


def main(argv: list[str] | None = None) -> None:
    p = _parser()
    a = p.parse_args(argv)
    spark = session()
    from folioflow.plans.ingest import Store, ingest
    from folioflow.plans.tools import Tools

    store = Store(spark, a.store)
    settings = load(a.settings) if a.settings else None
    tools = Tools(store, a.embed, a.rerank, *((settings.hybrid_dense_weight, settings.rerank_depth) if settings else ()))
    if a.command == "query":
        from folioflow.queries import QUERIES

        QUERIES[a.name](spark, a.tables).show(50, truncate=80)
    elif a.command == "ingest":
        topic = a.topic or (list(settings.focus_area_queries) if settings else None)
        ingest(store, spark.read.parquet(a.papers), spark.read.parquet(a.blocks), a.embed, topic, summarize=a.summarize)
    elif a.command == "harvest":
        from folioflow.plans.build import harvested

        if settings is None:
            p.error("harvest takes --settings")
        harvested(spark, settings, store.table("state"), **{k: x for k, x in (("fetch", a.fetch), ("folder", a.folder)) if x}).write.mode("overwrite").parquet(a.path)
    elif a.command == "build":
        from folioflow.plans.build import build

        if settings is None:
            p.error("build takes --settings")
        own = lambda path, ids: spark.read.parquet(path).join(ids, "paper_id", "left_semi")
        run = lambda ids: ingest(store, own(a.papers, ids), own(a.blocks, ids), a.embed, list(settings.focus_area_queries), summarize=a.summarize)
        print(build(store, settings, lambda: spark.read.parquet(a.papers), run, a.target, batch=a.batch))
    elif a.command == "eval":
        from folioflow.operators.evaluation import questions
        from folioflow.plans import evaluate
        from folioflow.sources.files import ground_truth

        truth = ground_truth(spark, a.truth)
        asked = questions(truth, ground_truth(spark, a.blind) if a.blind else truth)
        asked = asked.orderBy("question_id").limit(a.limit) if a.limit else asked
        ranks = evaluate.evaluated(store, asked, a.k, a.embed, a.rerank, *((settings.hybrid_dense_weight, settings.rerank_depth) if settings else ()))
        out = evaluate.write(ranks, a.k, a.report, not a.no_per_question) if a.report else evaluate.report(ranks, a.k, False)
        print(evaluate.summary(out))
    elif a.command in ("search", "papers"):
        if a.after and a.before and a.after > a.before:
            p.error("--after lies behind --before")
        run = tools.semantic_search if a.command == "search" else tools.search_papers
        rows, cover = run(a.text, Filters(a.categories, a.after, a.before), a.k or (settings.top_k if settings else None))
        if a.json:
            print("\n".join(as_json(rows) + as_json(cover)))
        else:
            rows.show(100, truncate=80)
            cover.show()
    elif a.command == "paper":
        tools.get_paper(a.id).show(vertical=True, truncate=200)
    elif a.command == "span":
        tools.get_span(a.id).show(truncate=False)
    elif a.command == "delete":
        store.delete(spark.createDataFrame([(i,) for i in a.ids], "paper_id string")).show(100, truncate=False)
    elif a.command == "export":
        from folioflow.operators.retrieval import sections_of
        from folioflow.sinks.notes import export

        now = store.here()
        papers = now.table("papers").orderBy("paper_id")
        papers = papers.limit(a.limit) if a.limit else papers
        export(papers.join(sections_of(now.table("blocks")), "paper_id", "left").join(now.table("summaries").select("paper_id", F.col("text").alias("summary")), "paper_id", "left"), a.path)
    elif a.command == "snapshot":
        from folioflow.sinks.snapshots import snapshot

        now = store.here()  # one commit of all tables, whatever is written meanwhile
        print(snapshot({t: df for t in TABLES if (df := now.table(t)) is not None}, a.path, a.keep))
    elif a.command == "vacuum":
        print(f"{store.vacuum(kept=a.keep)} parts removed")
    elif a.command == "integrity":
        from folioflow.operators.state import incomplete

        now = store.here()
        _shown(incomplete(now.table("state"), now.table("papers"), now.table("chunks"), now.table("blocks")), 100)
    elif a.command == "failures":
        _shown(store.table("quarantine").orderBy("ts", "paper_id"), 1000)
    else:
        from folioflow.operators.state import funnel

        funnel(store.table("state")).orderBy("ord").show()


if __name__ == "__main__":
    main()
