"""Document processing: groups, chunks, paths, text functions, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import markup
from folioflow.functions import text as tx
from folioflow.operators import chunking, models, parsing, search
from folioflow.queries.views import BLOCKS, LINES, tokens, with_, words
from folioflow.sources import tables
from folioflow.sources.tables import table

#: Limits of the test tables' chunks, whose blocks are short lines.
MOST, OVERLAP = 150, 60


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("role") == "system", "sys").otherwise("dlg")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").alias("idx"), section.alias("section_path"))


def runlength_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = chunking.grouped(_turns(spark, sf_dir))
    return g.groupBy("paper_id", "grp").agg(F.max("section_path").alias("section_path"), F.min("idx").alias("first_idx"), F.count("*").alias("n")).withColumn("grp", F.col("grp").cast("long"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.numbered(chunking.split(chunking.grouped(tables.blocks(spark, sf_dir)), MOST))


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return _parts(spark, sf_dir).select("block_id", long("grp"), long("part"), long("chunk_index"), long("words"))


def chunk_overlap_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = chunking.overlaps(_parts(spark, sf_dir), OVERLAP)
    return o.select("paper_id", F.col("grp").cast("long").alias("grp"), F.col("part").cast("long").alias("part"), F.col("overlap_idx").cast("long").alias("overlap_idx"))


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(tables.blocks(spark, sf_dir), tables.papers(spark, sf_dir), True, MOST, OVERLAP)
    return c.select("chunk_id", "section_path", "parent_id", F.md5("text").alias("text_md5"), F.length("anchor.snippet").cast("long").alias("snippet_chars"))


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line is a heading, of depth one, two and three in turn."""
    b = tables.blocks(spark, sf_dir)
    n, turn = F.expr("idx div 9 + 1").cast("string"), F.expr("(idx div 3) % 3")
    heading = F.when(turn == 0, F.concat(n, F.lit(" A"))).when(turn == 1, F.concat(n, F.lit(".1 B"))).otherwise(F.concat(n, F.lit(".1.1 C")))
    return b.select("paper_id", "idx", (F.col("idx") % 3 == 0).alias("heading"), heading.alias("text"))


def section_path_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.section_paths(_headed(spark, sf_dir)).select("paper_id", F.col("idx").cast("long").alias("idx"), "section_path")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words"))


def tf_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_counts(_docs(spark, sf_dir).withColumnRenamed("doc_id", "id"))


def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return search.document_frequencies(search.term_counts(d), d).select("token", "df", F.round("idf", 9).alias("idf"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token")).distinct()
    return t.select("token", tx.token_id(F.col("token")).alias("token_id"))


#: Headings and the depths that they must have.
HEADINGS = {"2.1: Foo": 2, "A1.2 Proof": 2, "A.1 More": 2, "4.5.1 Deep": 3, "3D models": 1, "3": 1, "Abstract": 1, " 2.2) Set off": 2, "a2.1.7 Low": 3, "A Name": 1}


def heading_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*[F.lit(h) for h in HEADINGS])).alias("text"))
    return _headed(spark, sf_dir).select("text").unionByName(hard).distinct().select("text", tx.heading_depth(F.col("text")).cast("long").alias("depth"))


#: Ends of papers: of which the first three are cut.
TAILS = ("\n## References\n[1] x", "\n### Supplementary material", "\n# APPENDIX a", "\n#### Appendix b", "\n# Acknowledgements", "\n## Appendixes")


def summary_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("doc_id") % len(TAILS) + 1).cast("int"))
    md = F.concat(F.lit("# T\n"), F.col("text"), tail)
    trimmed = tx.before_low_value_sections(md)
    return _docs(spark, sf_dir).select("doc_id", tx.first_heading(md).alias("title"), F.md5(tx.first_words(trimmed, 200)).alias("prompt_md5"))


def fake_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.papers(spark, sf_dir)
    return p.select("paper_id", F.md5(models.fake_summary(F.col("paper_id"), F.col("markdown"))).alias("summary_md5"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.col("user_id").cast("string").alias("paper_id"), F.concat(F.lit("v"), k).alias("version"), F.col("event_id").alias("seen"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.latest_versions(_versions(spark, sf_dir))


def version_sort_v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n"))
    return v.select("version", "n", tx.version_number(F.col("version")).cast("long").alias("number"))


def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = tables.published(F.col("doc_id"))
    xml = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2401."), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("v"), (F.col("doc_id") % 12 + 1).cast("string"), F.lit("</id><title> "), esc(F.substring_index("text", "\n", 1)),
        F.lit(" </title><summary>"), esc(F.col("text")), F.lit("</summary><author><name>A "), F.col("source"), F.lit("</name></author><author><name>B</name></author><category term=\""), F.col("lang"), F.lit("\"/><published>"),
        day.cast("string"), F.lit("T10:00:00Z</published><updated>"), day.cast("string"), F.lit("T12:00:00Z</updated></entry>"),
    )
    e = parsing.atom_entries(d.select(xml.alias("xml")))
    return e.select("paper_id", "version", "title", F.md5("abstract").alias("abstract_md5"), F.array_join("authors", "|").alias("authors"), F.array_join("categories", "|").alias("categories"), "published", "updated")


#: References as they are written: those with and without a prefix, glued to words, closed by a dot or a bracket.
RAW = ("See arXiv:2401.{n}v2 for more", "doi 10.1000/x{n} end", "J. Econ 2011.12345", "10.1257/aer.2011.1234.", "ARXIV: 2402.{n}", "marxiv:2401.{n}", "<10.5555/a.b.{n}>", "x10.1000/{n}", "arXiv:2401.{n}9", "plain")


def id_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    n = F.lpad(F.col("doc_id").cast("string"), 5, "0")
    raw = F.concat(F.element_at(F.array(*[F.lit(r) for r in RAW]), (F.col("doc_id") % len(RAW) + 1).cast("int")), F.lit(" "), F.col("text"))
    raw = F.replace(raw, F.lit("{n}"), n)
    refs = d.select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(0).alias("pos"), raw.alias("raw"))
    structured = d.filter("source = 'src0'").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(0).alias("pos"), F.lit("t").alias("title"), F.lit("10.5/s").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"))
    return parsing.references(refs, structured).select("paper_id", "title", "arxiv_id", "doi")


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as layout items and their pages: some without area, some furniture, some blank, headings, tables, figures, references."""
    b = tables.blocks(spark, sf_dir)
    n = F.col("idx")
    some = lambda c: F.array(F.lit(c), F.lit("b"))
    kind = F.when(n % 7 == 3, "header").when(n % 13 == 6, "footnote").when(n % 5 == 4, "algorithm").when(n % 17 == 8, "table").when(n % 17 == 9, "image").when(n % 17 == 10, "chart").when(n % 19 == 11, "list").otherwise("text")
    box = F.array(F.lit(100.0), F.lit(100.0), F.when(n % 11 == 5, 100.0).otherwise(500.0), F.lit(200.0))
    items = b.select(
        "paper_id", n.alias("pos"), kind.alias("type"), F.when(n % 2 == 0, "ref_text").alias("sub_type"),
        F.when(kind == "list", F.lit(None)).when(n % 4 == 0, F.concat(F.expr("idx div 8 + 1").cast("string"), F.lit(" H"))).when(n % 6 == 1, " ").otherwise(F.col("text")).alias("text"), F.when(n % 4 == 0, 2).alias("text_level"),
        F.array(F.col("text"), F.lit(" "), F.lit("b")).alias("list_items"), F.when(n % 3 == 0, F.concat(F.lit("<table><tr><th>h</th><th>i</th></tr><tr><td>"), n.cast("string"), F.lit("</td></tr></table>"))).when(n % 3 == 1, "").alias("table_body"),
        F.when(n % 9 != 2, some("cap")).alias("table_caption"), F.when(n % 4 != 3, F.concat(F.lit("i"), n.cast("string"))).alias("img_path"), some("an image").alias("image_caption"), some("a chart").alias("chart_caption"),
        F.lit(0).alias("page_idx"), box.alias("bbox"),
    )
    return items, b.select("paper_id", F.lit(0).alias("page_idx"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()


def parsed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.blocks(*_layout(spark, sf_dir)).select("block_id", "paper_id", F.col("idx").cast("long").alias("idx"), "type", F.md5("text").alias("text_md5"), F.round("bbox.x1", 6).alias("x1"), "section_path")


def parsed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.tables(*_layout(spark, sf_dir)).select("paper_id", F.col("pos").cast("long").alias("pos"), "markdown", "caption", F.round("bbox.y1", 6).alias("y1"))


def parsed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.figures(*_layout(spark, sf_dir)).select("paper_id", F.col("pos").cast("long").alias("pos"), "image_path", "caption", F.round("bbox.x0", 6).alias("x0"))


def raw_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.raw_references(*_layout(spark, sf_dir)).select("paper_id", F.col("pos").cast("long").alias("pos"), F.md5("raw").alias("raw_md5"))


def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the second source have lost their text, those of the third their blocks."""
    p = tables.papers(spark, sf_dir)
    md = p.select("paper_id", F.when(F.array_contains("categories", "src1"), " ").otherwise(F.col("markdown")).alias("markdown"))
    b = tables.blocks(spark, sf_dir).join(p.filter(~F.array_contains("categories", "src2")), "paper_id", "left_semi")
    good, bad = parsing.assembled(md, b)
    return good.select("paper_id", F.md5("markdown").alias("markdown_md5"), "n_blocks", F.lit(None).cast("string").alias("error")).unionByName(bad.select("paper_id", F.lit(None).cast("string").alias("markdown_md5"), F.lit(None).cast("long").alias("n_blocks"), "error"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page's menu, laid out as a table and turned into Markdown."""
    html = F.concat(F.lit("<table><tr><th>link</th></tr>"), F.array_join(F.transform(F.regexp_extract_all("html", F.lit("<li><a [^>]*>([^<]*)</a></li>"), 1), lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td></tr>"))), ""), F.lit("</table>"))
    return table(spark, sf_dir, "pages").select("page_id", markup.tables_as_markdown(html).alias("markdown"))


def normalized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(markup.normalized("text")).alias("text_md5"))


def fake_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", models.embedder(models.fake_vectors, models.DIM)("text").alias("vector"))


def tei_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for each line, of four forms in turn, as a parser's XML of its document, every eleventh of which is broken."""
    b = tables.blocks(spark, sf_dir)
    n, title = F.col("idx").cast("string"), F.concat(F.lit("T "), F.md5("text"))
    forms = [
        F.concat(F.lit('<biblStruct xml:id="b"><analytic><title level="a" type="main">'), title, F.lit('</title><idno type="DOI">10.1/'), n, F.lit('</idno></analytic><monogr><title level="j">J</title></monogr></biblStruct>')),
        F.concat(F.lit("<biblStruct>\n<monogr><title>"), title, F.lit('</title><idno type="PMID">1</idno><idno type="arXiv">2401.'), n, F.lit("</idno></monogr>\n</biblStruct>")),
        F.lit("<biblStruct ><monogr/></biblStruct>"),
        F.concat(F.lit('<biblStruct><analytic><title/></analytic><monogr><title level="m">'), title, F.lit('</title></monogr><idno type="DOI"> 10.2/'), n, F.lit(' </idno><idno type="DOI">10.3/x</idno></biblStruct>')),
    ]
    one = F.element_at(F.array(*forms), F.col("idx") % 4 + 1)
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><text><back><div><listBibl>', "</listBibl></div></back></text></TEI>"
    xml = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("one")))), lambda x: x["one"]), ""), F.when(F.col("paper_id").cast("int") % 11 == 0, "<oops>").otherwise(tail))
    good, bad = parsing.tei_references(b.groupBy("paper_id").agg(xml.alias("xml")))
    return good.select("paper_id", F.col("pos").cast("long").alias("pos"), "title", "doi", "arxiv_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("paper_id", "error"), allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (tei_references, runlength_groups, greedy_chunks, chunk_overlap_carry, chunk_texts, section_path_stack, snippet, word_counts, tf_bag, doc_freq_idf, token_ids, heading_depths, summary_prep, fake_summaries, latest_version, version_sort_v10, atom_entries, id_regex_extract, parsed_blocks, parsed_tables, parsed_figures, raw_references, assembled_documents, page_lists, normalized_items, fake_embed)}

_W = f"len({words('text')})"
_RUNS = """marked AS (SELECT *, CASE WHEN idx > min(idx) OVER (PARTITION BY paper_id) AND section_path IS DISTINCT FROM lag(section_path) OVER (PARTITION BY paper_id ORDER BY idx) THEN 1 ELSE 0 END AS new FROM {0}),
runs AS (SELECT * EXCLUDE new, sum(new) OVER (PARTITION BY paper_id ORDER BY idx) AS grp FROM marked)"""
_PARTS = f"""counted AS (SELECT *, {_W} AS words FROM runs),
placed AS (SELECT *, row_number() OVER (PARTITION BY paper_id, grp ORDER BY idx) AS n, sum(words) OVER (PARTITION BY paper_id, grp) AS total FROM counted),
walk AS (SELECT paper_id, grp, n, idx, 0 AS part, words AS used FROM placed WHERE n = 1
  UNION ALL
  SELECT p.paper_id, p.grp, p.n, p.idx, CASE WHEN p.total > {MOST} AND p.type = 'prose' AND w.used + p.words > {MOST} THEN w.part + 1 ELSE w.part END,
    CASE WHEN p.total > {MOST} AND p.type = 'prose' AND w.used + p.words > {MOST} THEN p.words ELSE w.used + p.words END
  FROM walk w JOIN placed p ON p.paper_id = w.paper_id AND p.grp = w.grp AND p.n = w.n + 1),
parts AS (SELECT p.*, w.part, dense_rank() OVER (PARTITION BY p.paper_id ORDER BY p.grp, w.part) - 1 AS chunk_index FROM placed p JOIN walk w USING (paper_id, grp, n)),
lasts AS (SELECT paper_id, grp, part, arg_max(idx, idx) AS idx, arg_max(words, idx) AS words, arg_max(text, idx) AS text FROM parts GROUP BY ALL),
carried AS (SELECT paper_id, grp, part, CASE WHEN lag(words) OVER w <= {OVERLAP} THEN lag(idx) OVER w END AS overlap_idx, CASE WHEN lag(words) OVER w <= {OVERLAP} THEN lag(text) OVER w END AS overlap_text FROM lasts WINDOW w AS (PARTITION BY paper_id, grp ORDER BY part))"""
_CHUNKED = with_(BLOCKS, _RUNS.format("blocks"), _PARTS, recursive=True)
_COLLAPSED = "array_to_string({}, ' ')"
_TRIM = r"regexp_replace(text, '^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$', '', 'g')"


def _snip(t: str) -> str:
    t = _TRIM.replace("(text,", f"({t},")
    return f"CASE WHEN length({t}) <= 200 THEN {t} WHEN regexp_extract(substr({t}, 1, 200), '(?s)^(.+) [^ ]*$', 1) <> '' THEN regexp_extract(substr({t}, 1, 200), '(?s)^(.+) [^ ]*$', 1) ELSE substr({t}, 1, 200) END"


_HEADED = """headed AS (SELECT cast(doc_id AS VARCHAR) AS paper_id, idx, idx % 3 = 0 AS heading, CASE (idx // 3) % 3 WHEN 0 THEN (idx // 9 + 1) || ' A' WHEN 1 THEN (idx // 9 + 1) || '.1 B' ELSE (idx // 9 + 1) || '.1.1 C' END AS text, (idx // 3) % 3 + 1 AS depth FROM lines)"""
_LAYOUT = with_(LINES, """items AS (SELECT cast(doc_id AS VARCHAR) AS paper_id, idx, text AS line,
  CASE WHEN idx % 7 = 3 THEN 'header' WHEN idx % 13 = 6 THEN 'footnote' WHEN idx % 5 = 4 THEN 'algorithm' WHEN idx % 17 = 8 THEN 'table' WHEN idx % 17 = 9 THEN 'image' WHEN idx % 17 = 10 THEN 'chart' WHEN idx % 19 = 11 THEN 'list' ELSE 'text' END AS type,
  CASE WHEN idx % 4 = 0 THEN (idx // 8 + 1) || ' H' WHEN idx % 6 = 1 THEN ' ' ELSE text END AS text, idx % 4 = 0 AS level2,
  CASE WHEN idx % 3 = 0 THEN '| h | i |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || idx || ' |  |' ELSE '' END AS md, CASE WHEN idx % 9 <> 2 THEN 'cap' || chr(10) || 'b' ELSE '' END AS caption FROM lines),
used AS (SELECT * FROM items WHERE type NOT IN ('header', 'footnote') AND idx % 11 <> 5),
pathed AS (SELECT *, last_value(CASE WHEN level2 AND type = 'text' THEN text END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY idx) AS path FROM used)""")

SQL = {
    "tei_references": with_(BLOCKS) + """SELECT paper_id, cast(idx AS BIGINT) AS pos, CASE WHEN idx % 4 < 2 THEN 'T ' || md5(text) END AS title, CASE idx % 4 WHEN 0 THEN '10.1/' || idx WHEN 3 THEN '10.2/' || idx END AS doi,
CASE WHEN idx % 4 = 1 THEN '2401.' || idx END AS arxiv_id, NULL AS error FROM blocks WHERE cast(paper_id AS INTEGER) % 11 <> 0
UNION ALL SELECT DISTINCT paper_id, NULL, NULL, NULL, NULL, 'unreadable XML of references' FROM blocks WHERE cast(paper_id AS INTEGER) % 11 = 0""",
    "runlength_groups": with_("turns AS (SELECT cast(conv_id AS VARCHAR) AS paper_id, turn AS idx, CASE WHEN role = 'system' THEN 'sys' ELSE 'dlg' END AS section_path FROM conversations)", _RUNS.format("turns")) + "SELECT paper_id, cast(grp AS BIGINT) AS grp, max(section_path) AS section_path, min(idx) AS first_idx, count(*) AS n FROM runs GROUP BY paper_id, grp",
    "greedy_chunks": _CHUNKED + "SELECT block_id, cast(grp AS BIGINT) AS grp, cast(part AS BIGINT) AS part, chunk_index, cast(words AS BIGINT) AS words FROM parts",
    "chunk_overlap_carry": _CHUNKED + "SELECT paper_id, cast(grp AS BIGINT) AS grp, cast(part AS BIGINT) AS part, cast(overlap_idx AS BIGINT) AS overlap_idx FROM carried",
    "chunk_texts": _CHUNKED
    + f"""SELECT paper_id || ':c' || chunk_index AS chunk_id, section_path, arg_min(block_id, idx) AS parent_id,
md5(any_value(title) || chr(10) || section_path || chr(10) || chr(10) || array_to_string(list_filter(list_concat([any_value(overlap_text)], list_filter(list(text ORDER BY idx), lambda t: t <> '')), lambda t: t IS NOT NULL), chr(10) || chr(10))) AS text_md5,
length({_snip('arg_min(text, idx)')}) AS snippet_chars
FROM parts JOIN carried USING (paper_id, grp, part) JOIN (SELECT cast(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title FROM documents) USING (paper_id) GROUP BY paper_id, chunk_index, section_path""",
    "section_path_stack": with_(LINES, _HEADED, """walk AS (SELECT paper_id, idx, [{'d': depth, 't': text}] AS stack FROM headed WHERE idx = 0
  UNION ALL SELECT h.paper_id, h.idx, CASE WHEN h.heading THEN list_concat(list_filter(w.stack, lambda x: x.d < h.depth), [{'d': h.depth, 't': h.text}]) ELSE w.stack END FROM walk w JOIN headed h ON h.paper_id = w.paper_id AND h.idx = w.idx + 1)""", recursive=True)
    + "SELECT paper_id, cast(idx AS BIGINT) AS idx, array_to_string(list_transform(stack, lambda x: x.t), ' > ') AS section_path FROM walk",
    "snippet": f"SELECT doc_id, {_snip('text')} AS snippet FROM documents",
    "word_counts": f"SELECT doc_id, {_W} AS words FROM documents",
    "tf_bag": f"SELECT id, token, count(*) AS tf FROM (SELECT doc_id AS id, unnest({tokens('text')}) AS token FROM documents) GROUP BY ALL",
    "doc_freq_idf": f"SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 9) AS idf FROM (SELECT doc_id, unnest(list_distinct({tokens('text')})) AS token FROM documents) GROUP BY 1",
    "token_ids": f"SELECT token, list_reduce(list_transform(string_split(sha1(token), ''), lambda c: cast(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, d: (a * 16 + d) % 2147483647) AS token_id FROM (SELECT DISTINCT unnest({tokens('text')}) AS token FROM benchmark)",
    "heading_depths": with_(LINES, _HEADED) + "SELECT DISTINCT text, cast(depth AS BIGINT) AS depth FROM headed UNION ALL (VALUES " + ", ".join(f"('{h}', cast({d} AS BIGINT))" for h, d in HEADINGS.items()) + ")",
    "summary_prep": f"""SELECT doc_id, 'T' AS title, md5(CASE WHEN len(w) > 200 THEN array_to_string(w[1:200], ' ') ELSE t END) AS prompt_md5 FROM (SELECT doc_id, t, {words('t')} AS w FROM (SELECT doc_id, '# T' || chr(10) || text || CASE doc_id % 6 WHEN 3 THEN chr(10) || '#### Appendix b' WHEN 4 THEN chr(10) || '# Acknowledgements' WHEN 5 THEN chr(10) || '## Appendixes' ELSE '' END AS t FROM documents))""",
    "fake_summaries": "SELECT cast(doc_id AS VARCHAR) AS paper_id, md5(CASE WHEN trim(coalesce(text, '')) = '' THEN '[fake summary: ' || doc_id || ']' ELSE substr(trim(text), 1, 500) END) AS summary_md5 FROM documents",
    "latest_version": "SELECT paper_id, version, seen FROM (SELECT cast(user_id AS VARCHAR) AS paper_id, 'v' || json_extract_string(props, '$.k') AS version, event_id AS seen, row_number() OVER (PARTITION BY user_id ORDER BY cast(json_extract_string(props, '$.k') AS INTEGER) DESC, event_id) AS r FROM events) WHERE r = 1",
    "version_sort_v10": "SELECT 'v' || json_extract_string(props, '$.k') AS version, count(*) AS n, cast(json_extract_string(props, '$.k') AS BIGINT) AS number FROM events GROUP BY ALL",
    "atom_entries": f"""SELECT '2401.' || lpad(cast(doc_id AS VARCHAR), 5, '0') AS paper_id, 'v' || (doc_id % 12 + 1) AS version, {_COLLAPSED.format(words("split_part(text, chr(10), 1)"))} AS title, md5({_COLLAPSED.format(words("text"))}) AS abstract_md5,
'A ' || source || '|B' AS authors, lang AS categories, cast(DATE '2020-01-01' + cast(doc_id % 1500 AS INTEGER) AS DATE) AS published, cast(DATE '2020-01-01' + cast(doc_id % 1500 AS INTEGER) AS DATE) AS updated FROM documents""",
    # what each kind of reference must give is written out; only the texts after them are searched
    "id_regex_extract": r"""WITH r AS (SELECT doc_id, source, text, lpad(cast(doc_id AS VARCHAR), 5, '0') AS n FROM documents)
SELECT cast(doc_id AS VARCHAR) AS paper_id, CASE WHEN source = 'src0' THEN 't' END AS title,
  coalesce(CASE doc_id % 10 WHEN 0 THEN '2401.' || n WHEN 4 THEN '2402.' || n END, nullif(regexp_extract(text, '(?i)\barxiv:\s*(\d{4}\.\d{4,5})(?:v\d+)?\b', 1), '')) AS arxiv_id,
  coalesce(CASE WHEN source = 'src0' THEN '10.5/s' END, CASE doc_id % 10 WHEN 1 THEN '10.1000/x' || n WHEN 3 THEN '10.1257/aer.2011.1234' WHEN 6 THEN '10.5555/a.b.' || n END, nullif(regexp_extract(text, '\b(10\.\d{4,9}/[^\s"<>]+)\b', 1), '')) AS doi FROM r""",
    "parsed_blocks": _LAYOUT
    + """, kept AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY idx) - 1 AS i FROM (SELECT *, CASE WHEN type = 'table' THEN coalesce(nullif(md, ''), caption) WHEN type = 'list' THEN line || chr(10) || ' ' || chr(10) || 'b' ELSE text END AS body FROM pathed) WHERE type NOT IN ('image', 'chart') AND NOT (type = 'list' AND idx % 2 = 0) AND trim(body) <> '')
SELECT paper_id || ':b' || i AS block_id, paper_id, i AS idx, CASE type WHEN 'algorithm' THEN 'code' WHEN 'table' THEN 'table' ELSE 'prose' END AS type, md5(body) AS text_md5, 306.0::DOUBLE AS x1, coalesce(path, '') AS section_path FROM kept""",
    "parsed_tables": _LAYOUT + "SELECT paper_id, cast(idx AS BIGINT) AS pos, md AS markdown, caption, 158.4::DOUBLE AS y1 FROM pathed WHERE type = 'table'",
    "parsed_figures": _LAYOUT + "SELECT paper_id, cast(idx AS BIGINT) AS pos, 'i' || idx AS image_path, CASE type WHEN 'image' THEN 'an image' ELSE 'a chart' END || chr(10) || 'b' AS caption, 61.2::DOUBLE AS x0 FROM pathed WHERE type IN ('image', 'chart') AND idx % 4 <> 3",
    "raw_references": _LAYOUT + "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY idx, k) - 1 AS pos, md5(raw) AS raw_md5 FROM (SELECT paper_id, idx, unnest([line, ' ', 'b']) AS raw, unnest([0, 1, 2]) AS k FROM pathed WHERE type = 'list' AND idx % 2 = 0) WHERE trim(raw) <> ''",
    "assembled_documents": "SELECT cast(doc_id AS VARCHAR) AS paper_id, CASE WHEN source <> 'src2' THEN md5(CASE WHEN source = 'src1' THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END) END AS markdown_md5, CASE WHEN source <> 'src2' THEN len(string_split(text, chr(10))) END AS n_blocks, CASE WHEN source = 'src2' THEN 'no blocks' END AS error FROM documents",
    "page_lists": "SELECT page_id, '| link |' || chr(10) || '| --- |' || array_to_string(list_transform(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1), lambda x: chr(10) || '| ' || x || ' |'), '') AS markdown FROM pages",
    "normalized_items": r"SELECT item_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM benchmark",
}
