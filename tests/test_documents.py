import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import chunking, parsing

BLOCK = "paper_id string, idx int, block_id string, type string, text string, page int, section_path string"


def blocks(spark, rows):
    """(words or text, type, section)"""
    return spark.createDataFrame([("p", i, f"p:b{i}", kind, t if isinstance(t, str) else " ".join(["w"] * t), 0, s) for i, (t, kind, s) in enumerate(rows)], BLOCK)


def titles(spark):
    return spark.createDataFrame([("p", "Title")], "paper_id string, title string")


def made(spark, rows, **kw):
    return chunking.chunks(blocks(spark, rows), titles(spark), **kw).orderBy("chunk_index").collect()


def test_sections_make_chunks_in_reading_order(spark):
    rows = [("3.2 Estimator\nprose", "prose", "3.2 Estimator"), ("x = y", "equation", "3.2 Estimator"), ("other", "prose", "4. Results"), ("code", "code", "5. Implementation")]
    got = made(spark, rows)
    assert [c.chunk_id for c in got] == ["p:c0", "p:c1", "p:c2"]
    assert got[0].text == "Title\n3.2 Estimator\n\nprose\n\nx = y"
    assert got[0].anchor.block_id == "p:b0"
    assert len(made(spark, rows, by_section=False)) == 4


def test_a_section_that_comes_back_is_another_run(spark):
    assert len(made(spark, [("a", "prose", "A"), ("b", "prose", "A"), ("c", "prose", "B"), ("d", "prose", "A")])) == 3


@pytest.mark.parametrize(
    ("rows", "n"),
    [([(900, "prose"), (900, "prose")], 2), ([(500, "prose"), (500, "prose")], 1), ([(1600, "prose"), ("x=y", "equation"), (200, "prose")], 2), ([(5000, "prose")], 1), ([(10, "prose"), (3000, "equation"), (10, "equation")], 1)],
)
def test_split_falls_before_prose_alone(spark, rows, n):
    assert len(made(spark, [(t, k, "S") for t, k in rows])) == n


def test_overlap_carries_a_short_last_block(spark):
    got = made(spark, [(1400, "prose", "S"), ("tail words", "caption", "S"), (900, "prose", "S")])
    assert len(got) == 2
    assert got[1].text.startswith("Title\nS\n\ntail words\n\nw w")
    assert got[1].anchor.block_id == "p:b2"
    long = made(spark, [(1300, "prose", "S"), (260, "caption", "S"), (900, "prose", "S")])
    assert not long[1].text.startswith("Title\nS\n\n" + "w " * 901)


def test_empty_blocks_give_no_chunks(spark):
    assert made(spark, []) == []


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    assert one(tx.tokens(F.lit(" A b C\x1cd "))) == ["a", "b", "c", "d"]
    assert one(tx.snippet(F.lit("  " + "ab " * 100))) == ("ab " * 67)[:200].rsplit(" ", 1)[0]
    assert one(tx.snippet(F.lit("x" * 300))) == "x" * 200
    assert one(tx.first_heading(F.lit("## no\n# Yes \n# later"))) == "Yes"
    assert one(tx.first_heading(F.lit("none"))) == ""
    assert one(tx.without_repeated_heading(F.lit("3.  Method\n\nbody"), F.lit("3. Method"))) == "body"
    assert one(tx.without_repeated_heading(F.lit("prose\nbody"), F.lit("3. Method"))) == "prose\nbody"
    assert [one(tx.heading_depth(F.lit(h))) for h in ("3 Method", "3.2 Estimator", "4.5.1 Deep", "A.1 More", "Abstract")] == [1, 2, 3, 2, 1]
    assert one(tx.slug(F.lit("math/0101 v1"))) == "math_0101_v1"
    assert one(tx.tag(F.lit("cs.LG"))) == "cs-LG"


def test_latest_version_is_numeric_and_first_seen(spark):
    refs = spark.createDataFrame([("a", "v9", 0), ("a", "v10", 1), ("a", "v10", 2), ("b", "v1", 3)], "paper_id string, version string, seen int")
    assert sorted((r.paper_id, r.version, r.seen) for r in parsing.latest_versions(refs).collect()) == [("a", "v10", 1), ("b", "v1", 3)]


def test_layout_items_to_blocks(spark):
    schema = "paper_id string, pos int, type string, text string, text_level int, list_items array<string>, page_idx int, bbox array<double>"
    box = [133.0, 154.0, 862.0, 224.0]
    rows = [
        ("p", 0, "text", "Title", 1, None, 0, box), ("p", 1, "text", "1 Intro", 2, None, 0, box), ("p", 2, "header", "running head", None, None, 0, box),
        ("p", 3, "text", "1.1 Lost heading", 2, None, None, box), ("p", 4, "algorithm", "step", None, None, 0, box), ("p", 5, "text", "  ", None, None, 0, box),
        ("p", 6, "list", None, None, ["a", "b"], 0, box), ("p", 7, "text", "flat", None, None, 0, [1.0, 1.0, 1.0, 2.0]), ("p", 8, "text", "1.2 Next", 2, None, 0, box), ("p", 9, "text", "far", None, None, 9, box),
    ]
    pages = spark.createDataFrame([("p", 0, 612.0, 792.0)], "paper_id string, page_idx int, width double, height double")
    got = parsing.blocks(spark.createDataFrame(rows, schema), pages).orderBy("idx").collect()
    assert [(b.block_id, b.type, b.text, b.section_path) for b in got] == [("p:b0", "prose", "Title", ""), ("p:b1", "prose", "1 Intro", "1 Intro"), ("p:b2", "code", "step", "1 Intro"), ("p:b3", "prose", "a\nb", "1 Intro"), ("p:b4", "prose", "1.2 Next", "1 Intro > 1.2 Next")]
    assert [round(x, 1) for x in got[0].bbox] == [81.4, 122.0, 527.5, 177.4]


def test_layout_tables_figures_and_references(spark):
    schema = "paper_id string, pos int, type string, sub_type string, text string, text_level int, list_items array<string>, table_body string, table_caption array<string>, img_path string, image_caption array<string>, chart_caption array<string>, page_idx int, bbox array<double>"
    box, none = [0.0, 0.0, 500.0, 500.0], None
    rows = [
        ("p", 0, "text", none, "2.1: Foo", 2, none, none, none, none, none, none, 0, box), ("p", 1, "footnote", none, "a note", none, none, none, none, none, none, none, 0, box),
        ("p", 2, "image", none, none, none, none, none, none, "a.png", ["one", "two"], none, 0, box), ("p", 3, "chart", none, none, none, none, none, none, none, none, ["lost"], 0, box),
        ("p", 4, "table", none, none, none, none, "<table><tr><td>x</td></tr></table>", ["T1"], none, none, none, 0, box), ("p", 5, "table", none, none, none, none, "", ["T2"], none, none, none, 0, box), ("p", 6, "table", none, none, none, none, none, none, none, none, none, 0, box),
        ("p", 7, "list", "ref_text", none, none, ["[1] a", " ", "[2] b"], none, none, none, none, none, 0, box), ("p", 8, "list", "text", none, none, ["x", "y"], none, none, none, none, none, 0, box), ("p", 9, "newkind", none, "odd", none, none, none, none, none, none, none, 0, box),
        ("p", 10, "list", "ref_text", none, none, ["[3] c"], none, none, none, none, none, 0, box),
    ]
    items = spark.createDataFrame(rows, schema)
    pages = spark.createDataFrame([("p", 0, 100.0, 100.0)], "paper_id string, page_idx int, width double, height double")
    got = parsing.blocks(items, pages).orderBy("idx").collect()
    assert [(b.type, b.text, b.section_path) for b in got] == [("prose", "2.1: Foo", "2.1: Foo"), ("table", "| x |\n| --- |", "2.1: Foo"), ("table", "T2", "2.1: Foo"), ("prose", "x\ny", "2.1: Foo"), ("prose", "odd", "2.1: Foo")]
    assert [(f.image_path, f.caption) for f in parsing.figures(items, pages).collect()] == [("a.png", "one\ntwo")]
    assert [(t.pos, t.caption) for t in parsing.tables(items, pages).orderBy("pos").collect()] == [(4, "T1"), (5, "T2"), (6, "")]
    assert [(r.pos, r.raw) for r in parsing.raw_references(items, pages).orderBy("pos").collect()] == [(0, "[1] a"), (1, "[2] b"), (2, "[3] c")]


def test_identifiers_in_references(spark):
    raw = {"J. Econ 2011.12345": (None, None), "arXiv: 2011.12345v3.": ("2011.12345", None), "doi:10.1257/aer.2011.1234.": (None, "10.1257/aer.2011.1234"), "(10.1234/abc)": (None, "10.1234/abc"), "marxiv:2011.12345": (None, None)}
    rows = spark.createDataFrame([(k,) for k in raw], "raw string").select("raw", parsing.arxiv_id(F.col("raw")).alias("a"), parsing.doi(F.col("raw")).alias("d")).collect()
    assert {r.raw: (r.a, r.d) for r in rows} == raw
    one = lambda t: spark.range(1).select(tx.before_low_value_sections(F.lit(t)).alias("x")).first().x
    assert one("a\n## References\nb") == "a" and one("a\n### supplementary x") == "a"
    for kept in ("a\n#### Appendix", "# References\nb", "a\n# Acknowledgements", "a\n## Appendixes"):
        assert one(kept) == kept


def test_bad_documents(spark):
    rows = [(1, b"%PDF-1.4 ..."), (2, b"\x1f\x8b..."), (3, bytes(257) + b"ustar"), (4, b"<html>")]
    got = spark.createDataFrame(rows, "n int, content binary").select("n", parsing.bad_document(F.col("content")).alias("bad")).collect()
    assert {r.n: r.bad for r in got} == {1: None, 2: "gzip", 3: "tar", 4: "not a pdf"}


def test_markup(spark):
    from folioflow.functions.markup import normal, normalized, table_markdown

    assert table_markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1 <b>2</b>|</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1 2\\| |  |"
    assert table_markdown(None) == table_markdown("<p>none</p>") == ""
    assert normal("ﬁne  x\n") == "fine x" and normal(None) is None
    assert [r.x for r in spark.createDataFrame([("①",), (None,)], "t string").select(normalized("t").alias("x")).collect()] == ["1", None]


def test_assembly(spark):
    md = spark.createDataFrame([("a", " "), ("b", "text"), ("c", "text")], "paper_id string, markdown string")
    b = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("b", 0, "x")], "paper_id string, idx int, text string")
    good, bad = parsing.assembled(md, b)
    assert {r.paper_id: r.markdown for r in good.collect()} == {"a": "one\n\ntwo", "b": "text"}
    assert [r.paper_id for r in bad.collect()] == ["c"]


def test_upper_case_by_character(spark):
    """Every character that may have an upper case, alone and within a text, as the SQL has it."""
    import duckdb

    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x11000), 0x1E922, *range(0x10D70, 0x10D86))]
    texts = [*chars, "", "straße ﬁn ŉa ᾳß", *("aß" + c + "ß" + c + "z" for c in "ßŉᾀǰé")]
    want = duckdb.connect().execute("SELECT list_transform(?, lambda x: upper(x))", [texts]).fetchall()[0][0]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", tx.upper(F.col("t")).alias("u")).orderBy("n").collect()
    assert [(t, r.u) for t, r in zip(texts, got, strict=True) if r.u != want[r.n]] == []
    assert spark.createDataFrame([(None,)], "t string").select(tx.upper(F.col("t"))).first()[0] is None


def test_upsert_replaces_by_character_and_keeps_rows_without_a_language(spark, tmp_path):
    from oracle import compare

    import duckdb

    from folioflow.queries import QUERIES, SQL

    spark.createDataFrame([(1, "straße", "es"), (2, "Maß", "fr"), (3, "gar", None), (4, "Fuß", "de"), (5, None, "es")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compare(spark, c, QUERIES["upsert_replace"], SQL["upsert_replace"], str(tmp_path))
