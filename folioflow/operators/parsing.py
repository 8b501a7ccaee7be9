"""Layout items and feeds to rows: blocks with section paths, references, versions of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import ARXIV_ID, DOI, collapse, heading_depth, version_number

#: Item types that aren't prose, those that are never read, and those that become figures.
BLOCK_TYPES = {"equation": "equation", "code": "code", "algorithm": "code", "table": "table"}
FURNITURE = ("header", "footer", "page_number", "aside_text", "page_footnote", "footnote")
FIGURES = ("image", "chart")
REFERENCES = "ref_text"

#: What items may have besides paper_id, pos, type, page_idx and bbox.
OPTIONAL = {"sub_type": "string", "text": "string", "text_level": "int", "list_items": "array<string>", "table_body": "string", "table_caption": "array<string>", "img_path": "string", "image_caption": "array<string>", "chart_caption": "array<string>"}


def block_type(item_type: Column) -> Column:
    out = F.lit("prose")
    for k, v in BLOCK_TYPES.items():
        out = F.when(item_type == k, v).otherwise(out)
    return out


def rescaled(bbox: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of the page to points."""
    return F.struct((bbox[0] / 1000.0 * width).alias("x0"), (bbox[1] / 1000.0 * height).alias("y0"), (bbox[2] / 1000.0 * width).alias("x1"), (bbox[3] / 1000.0 * height).alias("y1"))


def usable(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items on a known page with a box of some area that aren't furniture, with the box in points as `place`."""
    for name, kind in OPTIONAL.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    b = F.col("bbox")
    some = items.filter(F.col("page_idx").isNotNull() & (F.size("bbox") == 4) & (b[2] > b[0]) & (b[3] > b[1]) & ~F.coalesce("type", F.lit("")).isin(*FURNITURE))
    return some.join(pages, ["paper_id", "page_idx"]).withColumn("place", rescaled(b, F.col("width"), F.col("height")))


def _is_references() -> Column:
    return (F.col("type") == "list") & F.coalesce(F.col("sub_type") == REFERENCES, F.lit(False))


def _lines(c: str) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n")


#: Each heading pops what is as deep or deeper and stands on top; the path after every item.
_STACK = """
aggregate(
  ordered,
  named_struct('stack', cast(array() as array<struct<d:int,t:string>>), 'paths', cast(array() as array<string>)),
  (s, e) -> transform(
    array(if(e.heading, concat(filter(s.stack, x -> x.d < e.depth), array(named_struct('d', e.depth, 't', trim(e.text)))), s.stack)),
    st -> named_struct('stack', st, 'paths', concat(s.paths, array(array_join(transform(st, x -> x.t), ' > ')))))[0],
  s -> s.paths)
"""


def section_paths(items: DataFrame, by: str = "paper_id", at: str = "idx") -> DataFrame:
    """by, at, section_path: the path of headings in force at each item (by, at, heading BOOLEAN, text), a heading's own included."""
    depth = F.when(F.col("heading"), heading_depth(F.col("text"))).otherwise(0)
    e = items.select(by, F.struct(F.col(at).alias("at"), F.col("heading"), depth.cast("int").alias("depth"), F.when(F.col("heading"), F.col("text")).alias("text")).alias("e"))
    o = e.groupBy(by).agg(F.array_sort(F.collect_list("e")).alias("ordered"))
    z = o.select(by, F.explode(F.arrays_zip("ordered", F.expr(_STACK).alias("path"))).alias("z"))
    return z.select(by, F.col("z.ordered.at").alias(at), F.col("z.path").alias("section_path"))


def tables(items: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, pos, markdown, caption, page, bbox of the table items."""
    from folioflow.functions.markup import tables_as_markdown

    t = usable(items, pages).filter("type = 'table'")
    return t.select("paper_id", "pos", F.coalesce(tables_as_markdown("table_body"), F.lit("")).alias("markdown"), _lines("table_caption").alias("caption"), F.col("page_idx").alias("page"), F.col("place").alias("bbox"))


def figures(items: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, pos, image_path, caption, page, bbox of images and charts that have a picture."""
    f = usable(items, pages).filter(F.col("type").isin(*FIGURES) & (F.coalesce("img_path", F.lit("")) != ""))
    caption = F.when(F.col("type") == "image", _lines("image_caption")).otherwise(_lines("chart_caption"))
    return f.select("paper_id", "pos", F.col("img_path").alias("image_path"), caption.alias("caption"), F.col("page_idx").alias("page"), F.col("place").alias("bbox"))


def raw_references(items: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, pos, raw: the lines of the lists of references that aren't blank, numbered in reading order."""
    lists = usable(items, pages).filter(_is_references()).select("paper_id", F.col("pos").alias("at"), F.posexplode("list_items").alias("n", "raw"))
    return lists.filter(F.trim("raw") != "").select("paper_id", (F.row_number().over(Window.partitionBy("paper_id").orderBy("at", "n")) - 1).alias("pos"), "raw")


def blocks(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of layout items (paper_id, pos, type, page_idx, bbox, and what of OPTIONAL there is) on pages (paper_id, page_idx, width, height).

    Unusable items go first; a heading (text of level 2 or deeper) sets the path before its own block is labelled;
    figures and lists of references make no blocks; a table's text is its Markdown, or else its caption; blank ones
    then go; what is left is numbered densely in reading order.
    """
    u = usable(items, pages)
    heading = (F.col("type") == "text") & (F.coalesce("text_level", F.lit(0)) >= 2)
    paths = section_paths(u.withColumn("heading", heading & F.col("text").isNotNull()), "paper_id", "pos")
    text = F.coalesce(F.when(F.col("text") != "", F.col("text")), _lines("list_items"))
    body = u.filter(~F.coalesce("type", F.lit("")).isin("table", *FIGURES) & ~_is_references()).select("paper_id", "pos", "type", text.alias("body"), "page_idx", "place")
    t = tables(items, pages)
    body = body.unionByName(t.select("paper_id", "pos", F.lit("table").alias("type"), F.coalesce(F.nullif("markdown", F.lit("")), F.col("caption")).alias("body"), F.col("page").alias("page_idx"), F.col("bbox").alias("place")))
    kept = body.filter(F.trim("body") != "").join(paths, ["paper_id", "pos"])
    idx = F.row_number().over(Window.partitionBy("paper_id").orderBy("pos")) - 1
    out = kept.withColumn("idx", idx)
    return out.select(F.concat(F.col("paper_id"), F.lit(":b"), F.col("idx").cast("string")).alias("block_id"), "paper_id", "idx", block_type(F.col("type")).alias("type"), F.col("body").alias("text"), F.col("page_idx").alias("page"), F.col("place").alias("bbox"), "section_path")


def arxiv_id(text: Column) -> Column:
    """The first arXiv id in a text, without its version; null if there is none."""
    return F.nullif(F.regexp_extract(text, ARXIV_ID, 1), F.lit(""))


def doi(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DOI, 1), F.lit(""))


def references(raw: DataFrame, structured: DataFrame) -> DataFrame:
    """Raw references (paper_id, pos, raw) with ids: the structured ones at the same place (paper_id, pos, title, doi, arxiv_id), else found in the text."""
    j = raw.join(structured, ["paper_id", "pos"], "left")
    return j.select("paper_id", "pos", "raw", "title", F.coalesce("arxiv_id", arxiv_id(F.col("raw"))).alias("arxiv_id"), F.coalesce("doi", doi(F.col("raw"))).alias("doi"))


#: A reference of a parser's XML as far as it is read. Titles and ids may have attributes.
_TITLES, _IDS = "title:array<struct<_VALUE:string>>", "idno:array<struct<_type:string,_VALUE:string>>"
STRUCT = f"struct<analytic:struct<{_TITLES},{_IDS}>,monogr:struct<{_TITLES},{_IDS}>,{_IDS}>"


def tei_references(tei: DataFrame, xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(references: paper_id, pos, title, doi, arxiv_id; failures: paper_id, error_type, error) of a parser's XML (paper_id, xml).

    A reference is a `biblStruct` element; its title is the article's, or else that of what it is in; ids are its `idno` elements of type
    DOI and arXiv, the first of each. XML that can't be read fails its paper for now: the service may give better. A null text has no references.
    """
    whole = F.from_xml(F.col(xml), "struct<_bad:string>", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    seen = tei.select("paper_id", F.col(xml).alias("xml"), whole["_bad"].alias("bad"))
    failures = seen.filter("bad IS NOT NULL").select("paper_id", F.lit("TransientError").alias("error_type"), F.lit("unreadable XML of references").alias("error"))
    each = seen.filter("bad IS NULL AND xml IS NOT NULL").select("paper_id", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?biblStruct\b[^>]*/>|<(?:\w+:)?biblStruct\b.*?</(?:\w+:)?biblStruct>"), F.lit(0))).alias("pos", "one"))
    # the names of a prefix are those without it
    each = each.select("paper_id", "pos", F.from_xml(F.regexp_replace("one", r"(</?)\w+:(?=\w)", "$1"), STRUCT, {"rowTag": "biblStruct"}).alias("b"))
    first = lambda items: F.nullif(F.trim(F.get(items, F.lit(0))["_VALUE"]), F.lit(""))
    every = F.concat(*[F.coalesce(c, F.array().cast("array<struct<_type:string,_VALUE:string>>")) for c in (F.col("b.analytic.idno"), F.col("b.monogr.idno"), F.col("b.idno"))])
    of = lambda kind: first(F.filter(every, lambda i: i["_type"] == kind))
    has = lambda part: F.coalesce(F.size(f"b.{part}.title"), F.lit(0)) > 0
    title = F.when(has("analytic"), first(F.col("b.analytic.title"))).otherwise(first(F.col("b.monogr.title")))
    return each.select("paper_id", "pos", title.alias("title"), of("DOI").alias("doi"), of("arXiv").alias("arxiv_id")), failures


def latest_versions(refs: DataFrame, seen: str = "seen") -> DataFrame:
    """One row a paper: the numerically greatest version (v10 over v9), of equal ones the first seen."""
    w = Window.partitionBy("paper_id").orderBy(F.desc(version_number(F.col("version"))), F.asc(seen))
    return refs.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


ENTRY = "struct<id:string,title:string,summary:string,author:array<struct<name:string>>,category:array<struct<_term:string>>,published:string,updated:string>"


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of feed entries, each an `entry` element as text: ids apart from versions, blanks collapsed, dates."""
    e = feeds.select(F.from_xml(F.col(xml), ENTRY).alias("e")).select("e.*")
    parts = lambda g: F.regexp_extract("id", r"([^/]+?)(v\d+)?$", g)
    return e.select(
        parts(1).alias("paper_id"), F.coalesce(F.nullif(parts(2), F.lit("")), F.lit("v1")).alias("version"), collapse(F.col("title")).alias("title"), collapse(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: collapse(a["name"])).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.to_date(F.substring("published", 1, 10)).alias("published"), F.to_date(F.substring("updated", 1, 10)).alias("updated"),
    )


def bad_document(content: Column) -> Column:
    """Why bytes aren't a PDF: gzip, tar, or no PDF header; null if they are."""
    return F.when(F.substring(content, 1, 2) == F.unhex(F.lit("1F8B")), "gzip").when(F.substring(content, 258, 5) == F.encode(F.lit("ustar"), "utf-8"), "tar").when(F.substring(content, 1, 5) != F.encode(F.lit("%PDF-"), "utf-8"), "not a pdf")


def assembled(markdown: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: paper_id, markdown, n_blocks; failures: paper_id, error_type, error).

    A paper without blocks is a permanent failure. A blank or missing text is its blocks' texts in order.
    """
    b = blocks.groupBy("paper_id").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n").alias("joined"))
    j = markdown.join(b, "paper_id", "left")
    good = j.filter("n_blocks > 0").select("paper_id", F.coalesce(F.when(F.trim("markdown") != "", F.col("markdown")), F.col("joined")).alias("markdown"), "n_blocks")
    bad = j.filter("n_blocks IS NULL").select("paper_id", F.lit("PermanentError").alias("error_type"), F.lit("no blocks").alias("error"))
    return good, bad
