"""The store: commits over several tables, deletions by keys, vectors that are checked, stops at every step."""

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.plans.ingest import Store, ingest
from folioflow.sinks import commits
from folioflow.sinks.commits import Conflict, Tables


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int")


def rows(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_layers_and_deletions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Tables, "bytes_of", lambda self, parts: 0)
    t = Tables(spark, str(tmp_path))
    assert t.read("t") is None and t.version().number == 0
    with t.change() as c:
        c.put("t", pairs(spark, ("a", 1), ("a", 2), ("b", 3), (None, 0)), "k")
    with t.change() as c:
        c.put("t", pairs(spark, ("a", 4), ("c", 5), (None, 9)), "k", keys=pairs(spark, ("b", 0)))
    old = t.here()
    with t.change() as c:
        c.delete("t", pairs(spark, ("c", 0), ("zz", 0)), "k")
        c.put("t", pairs(spark, ("d", 5), ("d", 6)), "k")
        assert rows(c.read("t")) == sorted([("a", 4), ("d", 5), ("d", 6), (None, 0), (None, 9)], key=repr)
        c.delete("t", pairs(spark, ("", 6)).select("v"), "v")  # by another key: both count, in order
        c.put("t", pairs(spark, ("c", 6)), "k")
    assert rows(t.read("t")) == sorted([("a", 4), ("d", 5), ("c", 6), (None, 0), (None, 9)], key=repr)
    assert rows(old.read("t")) == sorted([("a", 4), ("c", 5), (None, 0), (None, 9)], key=repr)
    with t.change() as c:  # nothing changed, nothing committed
        c.delete("t", pairs(spark).limit(0), "k")
        c.put("t", pairs(spark).limit(0), "k")
        c.delete("other", pairs(spark, ("a", 1)), "k")
    assert t.version().number == 3
    with pytest.raises(ValueError, match="columns differ"), t.change() as c:
        c.put("t", spark.range(1), "id")
    plan = t.read("t").filter("k = 'a'").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan
    monkeypatch.setattr(commits, "MOST_LAYERS", 4)
    want = rows(t.read("t"))
    with t.change() as c:
        c.delete("t", pairs(spark, ("zz", 0)), "k")
    assert [p.kind for p in t.version().tables["t"]] == ["rows"] and rows(t.read("t")) == want


def test_stopped_anywhere_all_tables_are_old_or_new(spark, tmp_path, monkeypatch):
    t = Tables(spark, str(tmp_path))
    with t.change() as c:
        c.put("one", pairs(spark, ("a", 1)), "k")
        c.put("two", pairs(spark, ("a", 1)), "k")

    def work(c):
        c.put("one", pairs(spark, ("a", 2)), "k")
        c.delete("two", pairs(spark, ("a", 0)), "k")
        c.put("three", pairs(spark, ("x", 1)), "k")

    real_write, real_file, stops = commits.Change._write, commits.write_file, 0
    for step in range(20):
        left = [step]

        def stop(kept=left):
            if not kept[0]:
                raise KeyboardInterrupt
            kept[0] -= 1

        monkeypatch.setattr(commits.Change, "_write", lambda self, *a, **k: (stop(), real_write(self, *a, **k)))
        monkeypatch.setattr(commits, "write_file", lambda *a: (stop(), real_file(*a)))
        try:
            with t.change() as c:
                work(c)
            break
        except KeyboardInterrupt:
            stops += 1
            assert rows(t.read("one")) == [("a", 1)] and rows(t.read("two")) == [("a", 1)] and t.read("three") is None
    assert stops >= 5 and rows(t.read("one")) == [("a", 2)] and rows(t.read("two")) == [] and rows(t.read("three")) == [("x", 1)]


def test_two_writers_and_vacuum(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    with t.change() as c:
        c.put("t", pairs(spark, ("a", 1)), "k")
    slow = t.change()
    slow.put("t", pairs(spark, ("a", 7)), "k")
    with t.change() as c:
        c.put("t", pairs(spark, ("b", 2)), "k")
    with pytest.raises(Conflict):
        slow.commit()
    assert rows(t.read("t")) == [("a", 1), ("b", 2)]
    old = t.here()
    for n in range(3):
        with t.change() as c:
            c.replace("t", pairs(spark, ("c", n)))
    assert t.vacuum(kept=2) == 0  # nobody's parts are too young
    assert rows(old.read("t")) == [("a", 1), ("b", 2)]
    assert t.vacuum(kept=2, grace_ms=0) >= 3 and rows(t.read("t")) == [("c", 2)] and len(t.numbers()) == 2


def corpus(spark, n):
    papers = spark.createDataFrame([(f"p{i:03d}", f"# T{i}\ntext {i}", ["c"], date(2024, 1, 1)) for i in range(n)], "paper_id string, markdown string, categories array<string>, published date")
    blocks = spark.createDataFrame([(f"p{i:03d}:b{j}", f"p{i:03d}", j, "prose", f"words {i} {j} " * 20, 0, "S") for i in range(n) for j in range(2)], "block_id string, paper_id string, idx int, type string, text string, page int, section_path string")
    return papers, blocks


def gone(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "paper_id string")


def test_deletion_is_whole_and_small(spark, tmp_path, monkeypatch):
    """Stopped at each of its steps a deletion leaves the paper as it was; it writes ids, not tables."""
    store = Store(spark, str(tmp_path))
    papers, blocks = corpus(spark, 150)
    ingest(store, papers, blocks)
    weight, before = size(tmp_path), store.here()
    left = None
    real = commits.Change._write
    for step in range(12):
        left = [step]

        def stop(self, *a, kept=left, **k):
            if not kept[0]:
                raise KeyboardInterrupt
            kept[0] -= 1
            return real(self, *a, **k)

        if step < 3 or step == 7:  # some of its steps
            monkeypatch.setattr(commits.Change, "_write", stop)
            with pytest.raises(KeyboardInterrupt):
                store.delete(gone(spark, "p001"))
            assert store.table("papers").filter("paper_id = 'p001'").count() == 1 and store.table("state").filter("paper_id = 'p001' and stage = 'done'").count() == 1
    monkeypatch.setattr(commits.Change, "_write", real)
    assert size(tmp_path) == weight
    assert store.delete(gone(spark, "p001", "nobody")).count() == 2  # a chunk and a summary
    assert size(tmp_path) - weight < weight / 5
    for name in ("papers", "blocks", "chunks", "summaries", "terms", "vectors", "state"):
        assert store.table(name).filter("paper_id = 'p001'").count() == 0
        assert store.table(name).select("paper_id").distinct().count() == 149
    assert before.table("papers").count() == 150
    store.delete_vectors(spark.createDataFrame([("p002:summary",), ("zz",)], "id string"))
    assert store.table("vectors").filter("paper_id = 'p002'").count() == 1 and store.table("terms").filter("id = 'p002:summary'").count() == 0
    ingest(store, papers, blocks)
    assert store.table("papers").count() == 150 and store.table("state").filter("stage = 'done'").count() == 150


def test_vectors_are_checked(spark, tmp_path):
    from folioflow.plans.tools import Tools

    papers, blocks = corpus(spark, 4)
    store = Store(spark, str(tmp_path / "a"))

    def odd(texts):  # zeros for one paper, another length for one, nothing for one
        out = []
        for t in texts:
            if "words 1 " in t:
                out.append([0.0] * 1024)
            elif "words 2 " in t:
                out.append([1.0] * 7)
            elif "words 3 " not in t:
                out.append([2.0] * 1024)
        return out

    ingest(store, papers, blocks, embed=odd, topic=["words"])
    assert {r.paper_id: (r.error_type, r.error) for r in store.table("quarantine").collect()} == {
        "p001": ("PermanentError", "zero vector"), "p002": ("PermanentError", "a vector of 7 instead of 1024"), "p003": ("PermanentError", "0 vectors for 1 texts"),
    }
    assert {r.paper_id for r in store.table("state").collect()} == {"p000"}  # the rejected have no stage
    v = store.table("vectors").collect()
    assert {r.paper_id for r in v} == {"p000"} and all(len(r.embedding) == 1024 and abs(sum(x * x for x in r.embedding) - 1) < 1e-4 for r in v)
    assert store.dimension() == 1024
    hits, _ = Tools(store, embed=odd).semantic_search("words 0")
    assert {r.paper_id for r in hits.collect()} == {"p000"}
    with pytest.raises(Exception, match="a vector of 64 instead of 1024"):
        Tools(store).semantic_search("words")[0].collect()
    # a store's dimension holds for what comes later
    more = papers.withColumn("paper_id", F.concat(F.lit("x"), "paper_id")), blocks.withColumn("paper_id", F.concat(F.lit("x"), "paper_id")).withColumn("block_id", F.concat(F.lit("x"), "block_id"))
    ingest(store, *more, embed=lambda texts: [[1.0] * 64 for _ in texts])
    assert {r.error for r in store.table("quarantine").filter("paper_id like 'x%'").collect()} == {"a vector of 64 instead of 1024"}


def test_context_size(spark):
    from folioflow.plans.ingest import SUMMARY_WORDS, context_size

    assert SUMMARY_WORDS == 7356
    sized = spark.createDataFrame([("",), ("w " * 100,), ("w " * 3000,), ("w " * 9000,)], "t string").select(context_size(F.col("t")).alias("n")).collect()
    assert [r.n for r in sized] == [4096, 4096, 6800, 16384]
