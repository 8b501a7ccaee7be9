"""Blocks of papers to retrieval-sized chunks with provenance.

Blocks: paper_id, idx (reading order), block_id, type, text, page, section_path, words. Runs of one
section are groups; a group of too many words is split before prose blocks; a split part carries the
last block of the part before it if that is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import snippet, without_repeated_heading, word_count

MOST_WORDS, OVERLAP_WORDS = 1500, 250


def with_words(blocks: DataFrame) -> DataFrame:
    return blocks if "words" in blocks.columns else blocks.withColumn("words", word_count(F.col("text")))


def grouped(blocks: DataFrame, by_section: bool = True) -> DataFrame:
    """`blocks` with grp, from 0: runs of one section path in reading order, or every block for itself."""
    w = Window.partitionBy("paper_id").orderBy("idx")
    if not by_section:
        return blocks.withColumn("grp", F.row_number().over(w) - 1)
    new = F.coalesce((~F.col("section_path").eqNullSafe(F.lag("section_path").over(w))) & F.lag("idx").over(w).isNotNull(), F.lit(False))
    return blocks.withColumn("__new", new.cast("int")).withColumn("grp", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


#: The parts of a group's blocks in order: a part ends before a prose block that would take it past the limit.
_PARTS = """
aggregate(
  ordered,
  named_struct('part', 0, 'words', 0, 'size', 0, 'parts', cast(array() as array<int>)),
  (s, b) -> if(s.size > 0 and b.type = 'prose' and s.words + b.words > {most},
    named_struct('part', s.part + 1, 'words', b.words, 'size', 1, 'parts', concat(s.parts, array(s.part + 1))),
    named_struct('part', s.part, 'words', s.words + b.words, 'size', s.size + 1, 'parts', concat(s.parts, array(s.part)))),
  s -> s.parts)
"""


def split(groups: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """`groups` with part, from 0 in each group. Only groups of more than `most` words are folded."""
    g = with_words(groups)
    keys = ["paper_id", "grp"]
    w = Window.partitionBy(*keys)
    g = g.withColumn("total", F.sum("words").over(w))
    small = g.filter(F.col("total") <= most).withColumn("part", F.lit(0))
    large = g.filter(F.col("total") > most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "type", "words"))).alias("ordered"))
    parts = large.select(*keys, F.explode(F.arrays_zip("ordered", F.expr(_PARTS.format(most=most)).alias("part"))).alias("z")).select(*keys, F.col("z.ordered.idx").alias("idx"), F.col("z.part").alias("part"))
    split_ = g.filter(F.col("total") > most).join(parts, [*keys, "idx"])
    return small.unionByName(split_.select(*small.columns)).drop("total")


def numbered(parts: DataFrame) -> DataFrame:
    """`parts` with chunk_index: dense over all parts of a paper, from 0."""
    w = Window.partitionBy("paper_id").orderBy("grp", "part")
    return parts.withColumn("chunk_index", F.dense_rank().over(w) - 1)


def overlaps(parts: DataFrame, most: int = OVERLAP_WORDS) -> DataFrame:
    """paper_id, grp, part, overlap_idx, overlap_text: the last block of the part before, null if it has more than `most` words or there is none."""
    last = parts.groupBy("paper_id", "grp", "part").agg(F.max_by(F.struct("idx", "text", "words"), "idx").alias("last"))
    before = F.lag("last").over(Window.partitionBy("paper_id", "grp").orderBy("part"))
    return last.withColumn("b", before).select("paper_id", "grp", "part", F.when(F.col("b.words") <= most, F.col("b.idx")).alias("overlap_idx"), F.when(F.col("b.words") <= most, F.col("b.text")).alias("overlap_text"))


def chunks(blocks: DataFrame, titles: DataFrame, by_section: bool = True, most: int = MOST_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Chunks of every paper: chunk_id, paper_id, chunk_index, text, section_path, parent_id, anchor, contextual_header (null)."""
    parts = numbered(split(grouped(with_words(blocks), by_section), most))
    made = parts.groupBy("paper_id", "grp", "part", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("idx", "block_id", "text", "page", "section_path"))).alias("b"))
    first = F.col("b")[0]
    made = made.join(overlaps(parts, overlap), ["paper_id", "grp", "part"]).join(titles.select("paper_id", "title"), "paper_id", "left")
    head = without_repeated_heading(first["text"], first["section_path"])
    body = F.concat(F.array(head), F.transform(F.slice("b", F.lit(2), F.size("b")), lambda x: x["text"]))
    texts = F.concat(F.array_compact(F.array("overlap_text")), F.filter(body, lambda t: t != ""))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), first["section_path"], F.lit("\n\n"), F.array_join(texts, "\n\n"))
    anchor = F.struct(F.col("paper_id"), first["block_id"].alias("block_id"), first["page"].alias("page"), snippet(first["text"]).alias("snippet"), first["section_path"].alias("section_path"))
    return made.select(
        F.concat_ws(":", "paper_id", F.concat(F.lit("c"), F.col("chunk_index").cast("string"))).alias("chunk_id"), "paper_id", "chunk_index", text.alias("text"),
        first["section_path"].alias("section_path"), first["block_id"].alias("parent_id"), anchor.alias("anchor"), F.lit(None).cast("string").alias("contextual_header"),
    )
