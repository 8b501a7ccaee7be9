"""The four tools over a store: search passages, search papers, view a paper, read a span."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import tokens
from folioflow.operators import models, retrieval, search
from folioflow.operators.search import Filters
from folioflow.plans.ingest import Store


class Tools:
    """Each call reads the store as it is when the call begins."""

    def __init__(self, store: Store, embed: Callable | None = None, rerank: Callable | None = None, weight: float = 0.5, depth: int = retrieval.POOL):
        self.store, self.weight, self.depth = store, weight, depth
        self.embed, self.rerank = embed or models.fake_vectors, rerank

    def _now(self) -> Tools:
        """These tools with the store as it is now, whatever is written while a call runs."""
        return Tools(self.store.here(), self.embed, self.rerank, self.weight, self.depth)

    def _question(self, query: str) -> DataFrame:
        v = models.embedder(self.embed, self.store.dimension() or models.DIM)
        return self.store.spark.createDataFrame([(0, query)], "query_id int, text string").withColumn("vector", v("text"))

    def _terms(self, question: DataFrame) -> DataFrame | None:
        """The store's counted words that a question has, named in the plan so that the scan skips the rest; a store from before there were any has none."""
        terms = self.store.table("terms")
        if terms is None:
            return None
        words = [r.token for r in question.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).collect()]  # of one question
        return terms.filter(F.col("token").isin(words))

    def _pool(self, query: str, filters: Filters, kind: str, k: int) -> tuple[DataFrame, DataFrame]:
        """(pool, hits): the caller's kind never counts; without a reranker the fused order stays."""
        scoped = Filters(filters.categories, filters.published_after, filters.published_before, kind)
        vectors = self.store.table("vectors")
        question = self._question(query)
        pool = search.hybrid(vectors, question, scoped, self.weight, retrieval.pool_size(k, self.depth), terms=self._terms(question))
        if self.rerank is None:
            return pool, pool
        score = models.reranker(self.rerank)
        scored = pool.join(vectors.select("id", "text"), "id").withColumn("relevance", score(F.lit(query), F.col("text"))).drop("text")
        return pool, retrieval.reranked(scored, F.col("relevance"))

    def semantic_search(self, query: str, filters: Filters = Filters(), k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(passages with citations in order of place, coverage)."""
        n, now = retrieval.clamp_k(k), self._now()
        pool, hits = now._pool(query, filters, "chunk", n)
        chunks = now.store.table("chunks").select("chunk_id", "paper_id", F.col("anchor.block_id").alias("block_id"), "text")
        out = retrieval.grounded(hits, chunks, now.store.table("papers").select("paper_id", "title"), now.store.table("blocks"), n, retrieval.pool_size(n, self.depth))
        return out.orderBy("place"), retrieval.coverage(pool, out)

    def search_papers(self, query: str, filters: Filters = Filters(), k: int | None = None) -> tuple[DataFrame, DataFrame]:
        n, now = retrieval.clamp_k(k), self._now()
        pool, hits = now._pool(query, filters, "summary", n)
        out = retrieval.paper_results(hits, now.store.table("summaries"), now.store.table("papers"), retrieval.sections_of(now.store.table("blocks")), n)
        return out.orderBy("place"), retrieval.coverage(pool, out)

    def get_paper(self, paper_id: str) -> DataFrame:
        """One row; an error for an unknown paper."""
        now = self.store.here()
        p = now.table("papers").filter(F.col("paper_id") == paper_id)
        if not p.limit(1).count():
            raise KeyError(paper_id)
        return p.join(retrieval.sections_of(now.table("blocks")), "paper_id", "left").join(now.table("summaries").select("paper_id", F.col("text").alias("summary")), "paper_id", "left")

    def get_span(self, block_id: str) -> DataFrame:
        return retrieval.span(self.store.table("blocks"), block_id)
