"""The ingest plan: references to chunks, summaries, vectors and scores, as tables in a folder.

Each stage is one commit over all the tables that it writes, the stage that its papers have reached among them; a run goes on from there. A paper
that a stage can't work on goes to quarantine, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import before_low_value_sections, first_heading, first_words
from folioflow.operators import chunking, models, parsing, retrieval, search
from folioflow.operators.state import cascade_ids, quarantined, worklist
from folioflow.sinks.commits import Change, Tables
from folioflow.sinks.scratch import kept

#: Tokens of a summarizer's context, those of its prompt, and tokens of a word.
CONTEXT, PROMPT, TOKENS_PER_WORD = 16_384, 200, 2.2
LEAST_CONTEXT = 4_096
#: Words of a paper that a summary is made from, at most.
SUMMARY_WORDS = int((CONTEXT - PROMPT) / TOKENS_PER_WORD)
#: The stage that a paper begins with here.
FIRST = "parsed"
#: Tables with rows of papers.
OF_PAPERS = ("papers", "blocks", "chunks", "summaries", "terms", "vectors", "references", "figures", "tables", "state")


def context_size(text: F.Column) -> F.Column:
    """Tokens of context that a summarizer needs for a text: by its words, within the limits."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(LEAST_CONTEXT), F.least(F.floor(words * TOKENS_PER_WORD).cast("int") + PROMPT, F.lit(CONTEXT)))


class Store:
    """Tables of one folder: papers, blocks, chunks, summaries, terms, vectors, state, quarantine; all of them change by commits."""

    def __init__(self, spark: SparkSession, path: str, pinned: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = Tables(spark, path, pinned)

    def table(self, name: str) -> DataFrame | None:
        return self.tables.read(name)

    def here(self) -> Store:
        """The store as it is now, whatever is written later."""
        return Store(self.spark, self.path, self.tables.version().number)

    def change(self) -> Change:
        return self.tables.change()

    def put(self, name: str, new: DataFrame, key: str = "paper_id", order: str | None = None, keys: DataFrame | None = None) -> None:
        """Replace all rows of the new keys; the others aren't written again."""
        with self.change() as c:
            c.put(name, new, key, order, keys)

    def dimension(self) -> int | None:
        """Numbers of the store's vectors; None without any."""
        v = self.table("vectors")
        row = None if v is None else v.select(F.size("embedding").alias("n")).first()
        return row and row.n

    def delete(self, papers: DataFrame) -> DataFrame:
        """Remove papers everywhere, in one commit, and give the ids of their chunks and summaries; unknown papers are no error.

        What is written is the papers' ids in each table and the ids given. Stopped anywhere, all is as it was, and the deletion can be done again.
        """
        with self.change() as c:
            tables = {t: c.read(t) for t in ("chunks", "summaries")}
            none = lambda t, k: tables[t] if tables[t] is not None else self.spark.createDataFrame([], f"paper_id string, {k} string")
            c.replace("deleted", cascade_ids(none("chunks", "chunk_id"), none("summaries", "summary_id"), papers))
            for name in OF_PAPERS:
                c.delete(name, papers)
        return self.table("deleted")

    def delete_vectors(self, ids: DataFrame) -> None:
        """Remove vectors (id), and their counted words; unknown ids are no error."""
        with self.change() as c:
            for name in ("vectors", "terms"):
                c.delete(name, ids, "id")

    def reject(self, failures: DataFrame) -> None:
        """Papers (paper_id, error_type, error) to quarantine; the first reason stays, and they have no stage any more."""
        with self.change() as c:
            reject(c, failures)

    def pending(self, todo: DataFrame, stage: str) -> DataFrame:
        """paper_id of the papers that aren't there yet, as a table, since what follows changes the state.

        For the first stage those are all that haven't failed for good: one that a service failed for a time is tried again. For a later one they are
        those that have come through an earlier one.
        """
        now = self.here()
        out, state, dead = todo, now.table("state"), now.table("quarantine")
        if state is not None:
            out = worklist(out, state, stage)
            out = (out if stage == FIRST else out.filter("stage IS NOT NULL")).select("paper_id")
        if stage == FIRST and dead is not None:
            out = out.join(dead.filter("error_type = 'PermanentError'"), "paper_id", "left_anti")
        return kept(out.select("paper_id").distinct(), "pending")

    def vacuum(self, **limits: int) -> int:
        return self.tables.vacuum(**limits)


def reject(c: Change, failures: DataFrame) -> None:
    new, old = quarantined(failures.select("paper_id", "error_type", "error", F.current_timestamp().alias("ts"))), c.read("quarantine")
    new = kept(new if old is None else new.join(old, "paper_id", "left_anti"), "rejected")
    c.put("quarantine", new)
    c.delete("state", failures.select("paper_id"))


def reached(c: Change, papers: DataFrame, stage: str) -> None:
    c.put("state", papers.select("paper_id", F.lit(stage).alias("stage")).distinct())


def ingest(store: Store, papers: DataFrame, blocks: DataFrame, embed: Callable | None = None, topic: list[str] | None = None, by_section: bool = True, summarize: Callable | None = None, attempts: int = 3, wait_s: float = 0.0) -> None:
    """Chunk, summarize, embed and score papers (paper_id, markdown, categories, published, ...) with their blocks.

    Papers that are done, or in quarantine, are left alone; others go on from the stage that they have reached. A
    paper without blocks, and one whose text the summarizer or the embedder refuses after `attempts`, goes to
    quarantine, as does one with a vector that is missing, of zeros, or of another length than the store's (in an empty store: than
    that of the least id). Vectors are kept at length one. The topic vector is made once; a paper's relevance is the cosine of its summary's vector with it.
    """
    ids = papers.select("paper_id").distinct()

    todo = store.pending(ids, "parsed")
    with store.change() as c:
        own = papers.join(todo, "paper_id", "left_semi")
        good, bad = parsing.assembled(own.select("paper_id", "markdown"), blocks.join(todo, "paper_id", "left_semi"))
        own = own.drop("markdown").join(good.select("paper_id", "markdown"), "paper_id")
        title = first_heading(F.col("markdown"))
        c.put("papers", own.withColumn("title", F.coalesce(F.nullif(title, F.lit("")), F.col("title")) if "title" in papers.columns else title).withColumn("relevance_score", F.lit(None).cast("double")), keys=todo)
        c.put("blocks", blocks.join(good, "paper_id", "left_semi"), keys=todo)
        reached(c, good, "parsed")
        reject(c, bad)

    todo = store.pending(ids, "chunked")
    with store.change() as c:
        c.put("chunks", chunking.chunks(_of(c, "blocks", todo), _of(c, "papers", todo), by_section), keys=todo)
        reached(c, todo, "chunked")

    todo = store.pending(ids, "summarized")
    with store.change() as c:
        own = _of(c, "papers", todo).select("paper_id", "markdown")
        if summarize is None:
            said = own.select("paper_id", F.lit(True).alias("ok"), models.fake_summary(F.col("paper_id"), F.col("markdown")).alias("value"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error"))
        else:
            said = own.select("paper_id", models.guarded(summarize, attempts, wait_s=wait_s)(first_words(before_low_value_sections(F.col("markdown")), SUMMARY_WORDS)).alias("r")).select("paper_id", "r.*")
        said = kept(said, "said")
        c.put("summaries", said.filter("ok").select(F.concat("paper_id", F.lit(":summary")).alias("summary_id"), "paper_id", F.col("value").alias("text")), keys=todo)
        reached(c, said.filter("ok"), "summarized")
        reject(c, said.filter("not ok"))

    todo = store.pending(ids, "embedded")
    dim = store.dimension()
    with store.change() as c:
        rows = _of(c, "summaries", todo).select(F.col("summary_id").alias("id"), F.lit("summary").alias("kind"), "paper_id", "text", F.lit("").alias("section_path"))
        rows = rows.unionByName(_of(c, "chunks", todo).select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), "paper_id", "text", "section_path"))
        vector = models.guarded(models.unit_vectors(embed or models.fake_vectors), attempts, value=T.ArrayType(T.FloatType()), wait_s=wait_s)
        made = kept(rows.withColumn("r", vector("text")), "embedded")
        if dim is None:
            first = made.filter("r.ok").agg(F.min_by(F.size("r.value"), "id").alias("n")).first()
            dim = first.n or 0
        size = F.size("r.value")
        wrong = F.col("r.ok") & (size != dim)
        why = F.when(wrong, F.concat(F.lit("a vector of "), size.cast("string"), F.lit(f" instead of {dim}"))).otherwise(F.col("r.error"))
        lost = made.filter(~F.col("r.ok") | wrong).select("paper_id", "id", F.when(wrong, "PermanentError").otherwise(F.col("r.error_type")).alias("error_type"), why.alias("error"))
        lost = kept(lost.groupBy("paper_id").agg(F.min_by("error_type", "id").alias("error_type"), F.min_by("error", "id").alias("error")), "lost")
        good = made.join(lost, "paper_id", "left_anti").join(_of(c, "papers", todo).select("paper_id", "categories", "published"), "paper_id")
        c.put("terms", search.kept_terms(good, ("paper_id",)), order="token", keys=todo)
        c.put("vectors", good.select(*rows.columns, "categories", "published", F.col("r.value").alias("embedding")), keys=todo)
        reached(c, good, "embedded")
        reject(c, lost)

    todo = store.pending(ids, "done")
    with store.change() as c:
        if topic and dim:
            t = store.spark.createDataFrame([(" ".join(topic),)], "text string").select(models.embedder(embed or models.fake_vectors, dim)("text").alias("vector"))
            s = retrieval.relevance(_of(c, "vectors", todo).filter("kind = 'summary'"), t).select(F.regexp_replace("id", ":summary$", "").alias("paper_id"), "relevance_score")
            c.put("papers", kept(_of(c, "papers", todo).drop("relevance_score").join(s, "paper_id", "left"), "scored"))
        reached(c, todo, "done")


def ingest_layout(store: Store, papers: DataFrame, items: DataFrame, pages: DataFrame, tei: DataFrame | None = None, contents: DataFrame | None = None, **how) -> None:
    """Ingest of papers from a parser's layout items and pages, with their figures, tables and references stored.

    `tei`: the parser's XML of references (paper_id, xml), joined to the raw ones by place. `contents` (paper_id, content): bytes that aren't
    a PDF send their paper to quarantine, as does XML that can't be read. `how`: of `ingest`. Papers that are parsed already are left alone.
    """
    ids = papers.select("paper_id").distinct()
    todo = store.pending(ids, "parsed")
    own_items, own_pages = (df.join(todo, "paper_id", "left_semi") for df in (items, pages))
    bad = store.spark.createDataFrame([], "paper_id string, error_type string, error string")
    if contents is not None:
        why = parsing.bad_document(F.col("content"))
        bad = bad.unionByName(contents.join(todo, "paper_id", "left_semi").select("paper_id", F.lit("PermanentError").alias("error_type"), why.alias("error")).filter("error IS NOT NULL"))
    structured = store.spark.createDataFrame([], "paper_id string, pos int, title string, doi string, arxiv_id string")
    if tei is not None:
        structured, unreadable = parsing.tei_references(tei.join(todo, "paper_id", "left_semi"))
        bad = bad.unionByName(unreadable)
    bad = kept(bad, "unreadable")
    good = kept(todo.join(bad, "paper_id", "left_anti"), "readable")
    with store.change() as c:
        c.put("references", parsing.references(parsing.raw_references(own_items, own_pages).join(good, "paper_id", "left_semi"), structured), keys=todo)
        for name, rows in (("figures", parsing.figures(own_items, own_pages)), ("tables", parsing.tables(own_items, own_pages))):
            c.put(name, rows.join(good, "paper_id", "left_semi"), keys=todo)
        reject(c, bad)
    ingest(store, papers.join(bad, "paper_id", "left_anti"), parsing.blocks(own_items, own_pages), **how)


def _of(c: Change, name: str, some: DataFrame) -> DataFrame:
    return c.read(name).join(some, "paper_id", "left_semi")
