"""Posting lists in blocks of rows, each with its greatest count, and a top-k search that skips blocks.

Rows of a segment are numbered by id and cut to blocks of SIZE; a posting row has a word's rows of one block. The
blocks' greatest counts bound what any row of a block can score. A search scores the blocks of highest bound
first, takes from them the score that each question's last place needs, and then only the blocks whose bound
reaches it. Counts of rows and of each word's rows are kept as sums of what every change adds and takes away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import tokens
from folioflow.operators.fusion import ranked
from folioflow.operators.ordering import numbered
from folioflow.operators.search import term_counts
from folioflow.sinks.commits import Change, Tables
from folioflow.sinks.scratch import kept

#: Rows of a block; blocks of a question that are scored first.
SIZE, FIRST = 32, 8
#: Bounds and scores are sums in different orders.
SLACK = 1e-6


class Postings:
    """Tables of a folder: postings (token, block, ids, tfs), bounds (token, block, most), rows (id, block, tokens), counts (token, n; the empty word counts rows)."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def add(self, rows: DataFrame, name: str = "text") -> None:
        """A segment of new rows (id, text). Ids that are there already are replaced. Null text has no words."""
        with self.tables.change() as c:
            self._remove(c, rows.select("id"))
            segment = uuid.uuid4().hex[:12]
            text = F.coalesce(F.col(name), F.lit(""))
            placed = numbered(rows.select("id", text.alias("text")), "id", "row")
            block = F.concat_ws(":", F.lit(segment), F.lpad(F.expr(f"row div {SIZE}").cast("string"), 12, "0"))
            placed = kept(placed.select("id", block.alias("block"), "text"), "placed")
            held = placed.select("id", "block", F.array_distinct(tokens(F.col("text"))).alias("tokens"))
            terms = kept(term_counts(placed, "id").join(placed.select("id", "block"), "id"), "terms")
            c.append("rows", held, "id")
            c.append("postings", terms.groupBy("token", "block").agg(F.collect_list(F.struct("id", "tf")).alias("rows")).select("token", "block", F.col("rows.id").alias("ids"), F.col("rows.tf").alias("tfs")), "token")
            c.append("bounds", terms.groupBy("token", "block").agg(F.max("tf").alias("most")), "token")
            c.append("counts", self._counted(held, 1), "token")

    def remove(self, ids: DataFrame) -> None:
        """Rows (id) go: their ids and the counts that they take away are written, no posting list is."""
        with self.tables.change() as c:
            self._remove(c, ids)

    @staticmethod
    def _counted(rows: DataFrame, sign: int) -> DataFrame:
        words = rows.select(F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token"))
        return words.groupBy("token").agg((F.count("*") * sign).alias("n"))

    def _remove(self, c: Change, ids: DataFrame) -> None:
        have = c.read("rows")
        if have is None:
            return
        gone = kept(have.join(ids.select("id").distinct(), "id", "left_semi"), "gone")
        if gone.isEmpty():
            return
        c.append("counts", self._counted(gone, -1), "token")
        c.delete("rows", gone, "id")
        left = gone.select("id", "block")
        c.append("removed", left)

    def counts(self, words: DataFrame | None = None) -> DataFrame:
        """token, n; the empty word's n is the number of rows."""
        t = self.tables.read("counts")
        if words is not None:
            t = t.join(words, "token", "left_semi")
        return t.groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0")

    def topk(self, questions: DataFrame, most: int, exhaustive: bool = False) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, score, rank of each question's best rows by TF-IDF; query_id, block of those that were scored).

        The same as scoring all rows: a block is left out only where its bound lies below the score of the place `most`. `exhaustive` scores every block.
        """
        now = Postings(self.tables.here())
        asked = term_counts(questions, "query_id").withColumnRenamed("tf", "asked")
        words = asked.select("token").distinct()
        seen = kept(now.counts(words.unionByName(words.sparkSession.createDataFrame([("",)], "token string"))), "counts")
        total = F.coalesce(F.max(F.when(F.col("token") == "", F.col("n"))), F.lit(0))
        n = seen.agg(total.alias("n")).first().n
        idf = F.log((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
        wanted = kept(asked.join(seen.filter("token <> ''").select("token", idf.alias("idf")), "token").select("query_id", "token", "asked", "idf"), "asked")
        bounds = now.tables.read("bounds").join(wanted, "token")
        bound = bounds.groupBy("query_id", "block").agg(F.sum(F.col("most") * F.col("asked") * F.col("idf")).alias("bound"))
        bound = kept(bound, "bounds")
        if exhaustive:
            chosen = bound
            return ranked(now._scored(wanted, chosen), ["query_id"], most), chosen.select("query_id", "block")
        first = ranked(bound, ["query_id"], FIRST, "bound", "block").select("query_id", "block")
        first = kept(first, "first")
        early = kept(now._scored(wanted, first), "early")
        last = ranked(early, ["query_id"], most).groupBy("query_id").agg(F.when(F.count("*") >= most, F.min("score")).otherwise(F.lit(0.0)).alias("needed"))
        rest = bound.join(first, ["query_id", "block"], "left_anti").join(last, "query_id", "left").filter(F.col("bound") >= F.coalesce("needed", F.lit(0.0)) - SLACK).select("query_id", "block")
        rest = kept(rest, "rest")
        found = early.unionByName(now._scored(wanted, rest))
        return ranked(found, ["query_id"], most), first.unionByName(rest)

    def _scored(self, wanted: DataFrame, chosen: DataFrame) -> DataFrame:
        """query_id, id, score of all rows of the chosen blocks that share a word with the question; rows that were removed have none."""
        lists = self.tables.read("postings").join(wanted.join(chosen, "query_id"), ["token", "block"])
        each = lists.select("query_id", "block", "asked", "idf", F.explode(F.arrays_zip("ids", "tfs")).alias("r")).select("query_id", "block", F.col("r.ids").alias("id"), (F.col("r.tfs") * F.col("asked") * F.col("idf")).alias("part"))
        removed = self.tables.read("removed")
        if removed is not None:
            each = each.join(removed, ["id", "block"], "left_anti")
        out = each.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
        return out.filter("score > 0")


def read_rows(postings: Postings, questions: DataFrame, blocks: DataFrame) -> int:
    """How many posting rows a search of these blocks reads."""
    words = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return postings.tables.read("bounds").join(words, "token").join(blocks, ["query_id", "block"]).count()
