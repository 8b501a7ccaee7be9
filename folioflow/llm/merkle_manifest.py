"""A Merkle manifest of a dataset: a hash of every row, a tree for each source, a root over them all, and proofs.

Leaves of a source stand in order of id and are sorted over ranges, so each partition holds a stretch of
consecutive leaves with known indices. A task keeps a mountain range, a stack of the nodes whose run isn't
full; a full run of FANOUT carries to the next level, like a digit of a number. What a stretch can't finish,
at its two edges, goes on to merging rounds in which ever more neighbouring stretches meet; there are a few
edge nodes for each stretch and level, so nothing of a source gathers anywhere. A run that ends the level may
be short, and is hashed as it is, without padding. The sources' roots are leaves of one more tree, built alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import discard, documents, fold, ship, written

FANOUT = 3
#: Leaves of a stretch, about; stretches that meet in a merging round.
STRETCH, MEET = 1 << 17, 64
#: Levels that a tree of 2**62 leaves has.
_LEVELS = 40

NODES = "tag string, level int, idx long, digest string, made boolean, edge boolean, part long, total long"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def source_tag(c: str = "source") -> Column:
    """Tells a null source from any named one, and comes before it."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The hash of a row: each value as its bytes' count and itself, a null as a dash."""

    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


class Mountains:
    """The stack of a stretch. Nodes are pushed from left to right; `made` gets those that carries make, `edges` those whose run lies in part elsewhere."""

    def __init__(self, total: int):
        self.total = total
        self.waiting: list[list[tuple[int, str]]] = []
        self.sizes = [total]
        self.made: list[tuple[int, int, str]] = []
        self.edges: list[tuple[int, int, str]] = []
        self.top: str | None = None

    def push(self, level: int, idx: int, value: str) -> None:
        while True:
            while len(self.waiting) <= level:
                self.waiting.append([])
                self.sizes.append(-(-self.sizes[-1] // FANOUT))
            if self.sizes[level] == 1:
                self.top = value
                return
            run = self.waiting[level]
            run.append((idx, value))
            if idx % FANOUT != FANOUT - 1 and idx != self.sizes[level] - 1:
                return
            self.waiting[level] = []
            if run[0][0] % FANOUT:  # the run's beginning lies before this stretch
                self.edges += [(level, i, v) for i, v in run]
                return
            level, idx, value = level + 1, idx // FANOUT, digest(*[v for _, v in run])
            self.made.append((level, idx, value))

    def close(self) -> None:
        for level, run in enumerate(self.waiting):
            self.edges += [(level, i, v) for i, v in run]


def _node_rows(tag: str, part: int, m: Mountains) -> list[tuple]:
    """The nodes that a stretch made, the edges that it leaves open, and a leaf that is alone in its tree."""
    m.close()
    made, edges = {(level, i) for level, i, _ in m.made}, {(level, i) for level, i, _ in m.edges}
    rows = [(tag, level, i, v, True, (level, i) in edges, part, m.total) for level, i, v in m.made]
    rows += [(tag, level, i, v, False, True, part, m.total) for level, i, v in m.edges if (level, i) not in made]
    return rows if m.total > 1 else [(tag, 0, 0, m.top, False, False, part, 1)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_NODE_SCHEMA = pa.schema([("tag", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("made", pa.bool_()), ("edge", pa.bool_()), ("part", pa.int64()), ("total", pa.int64())])


def _stretch(leaves: pa.Table, runs: pa.Table) -> pa.Table:
    """The nodes of a stretch: its leaves in order of row; runs: for each tag in it the index of its first leaf here, and all its leaves."""
    begin = {r["tag"]: (r["start"], r["total"], r["part"]) for r in runs.to_pylist()}
    leaves, out = leaves.sort_by("row"), []
    tag, m, idx = None, None, 0
    for t, value in zip(leaves["tag"].to_pylist(), leaves["leaf"].to_pylist(), strict=True):
        if t != tag:
            if m is not None:
                out += _node_rows(tag, begin[tag][2], m)
            tag, idx, m = t, begin[t][0], Mountains(begin[t][1])
        m.push(0, idx, value)
        idx += 1
    if m is not None:
        out += _node_rows(tag, begin[tag][2], m)
    return _table(out, _NODE_SCHEMA)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge nodes in order of (tag, part, start) to the nodes that they make, and the edges still open."""
    at, m = None, None
    for b in batches:
        out: list[tuple] = []
        for tag, part, level, idx, value, total in zip(*(b[c].to_pylist() for c in ("tag", "part", "level", "idx", "digest", "total")), strict=True):
            if (tag, part) != at:
                if m is not None:
                    out += _node_rows(*at, m)
                at, m = (tag, part), Mountains(total)
            m.push(level, idx, value)
        yield from _table(out, _NODE_SCHEMA).to_batches()
    if m is not None:
        yield from _table(_node_rows(*at, m), _NODE_SCHEMA).to_batches()


class Forest(NamedTuple):
    """Trees of leaves by tag. rows: part, row, tag, leaf and what came with it; runs: part, tag, start, here, total; nodes: all above the leaves; border: nodes of runs that lie in several stretches; tops: tag, top."""

    rows: DataFrame
    runs: DataFrame
    nodes: DataFrame
    border: DataFrame
    tops: DataFrame


def forest(leaves: DataFrame, order: list[Column]) -> Forest:
    """A tree for each tag of `leaves` (tag, leaf, ...), a written table, its leaves in the given order within it."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // STRETCH))
    own = leaves.repartitionByRange(parts, F.asc("tag"), *order).sortWithinPartitions(F.asc("tag"), *order)
    rows = written(own.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "merkle-rows")
    runs = rows.groupBy("tag", "part").agg(F.count("*").alias("here"))
    whole = Window.partitionBy("tag")  # a row for each stretch that a tag lies in
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.select("part", "tag", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"), "here", F.sum("here").over(whole).alias("total")), "merkle-runs")
    first = written(rows.select("part", "row", "tag", "leaf").groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(_stretch, NODES), "merkle-nodes")
    every, border, open_ = [first], [first.filter("edge")], first.filter("edge")
    last = runs.agg(F.max("part")).first()[0] or 0
    power = F.element_at(F.array(*[F.lit(FANOUT**k).cast("long") for k in range(_LEVELS)]), F.col("level") + 1)
    while last:
        last //= MEET
        met = open_.withColumn("part", F.expr(f"part div {MEET}")).withColumn("start", F.col("idx") * power)
        met = written(met.repartition("tag", "part").sortWithinPartitions("tag", "part", "start").mapInArrow(_merge, NODES), "merkle-merged")
        every.append(met)
        border.append(met.filter("made"))
        open_ = met.filter("edge")
    node = ("tag", "level", "idx", "digest")
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    tops = union(every).filter((power >= F.col("total")) & ~F.col("edge")).select("tag", F.col("digest").alias("top"))
    return Forest(rows, runs, union([e.filter("made").select(*node) for e in every]), union([b.select(*node) for b in border]), tops)


def _needs(f: Forest) -> DataFrame:
    """part, tag, level, idx, digest: of every stretch the border nodes beside its own, by which its leaves reach the top."""
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(FANOUT**k).cast("long").alias("width")) for k in range(_LEVELS - 1)]))
    ends = f.runs.filter("here < total").select("part", "tag", "start", (F.col("start") + F.col("here") - 1).alias("stop"), "total", level.alias("l")).filter("l.width < total")
    both = ends.select("part", "tag", F.col("l.level").alias("level"), F.explode(F.array_distinct(F.array(F.expr(f"start div l.width div {FANOUT}"), F.expr(f"stop div l.width div {FANOUT}")))).alias("run"))
    return both.join(f.border.withColumn("run", F.expr(f"idx div {FANOUT}")), ["tag", "level", "run"]).select("part", "tag", "level", "idx", "digest")


class Climb:
    """The way from each leaf of a stretch to the top: the digests beside it, left and right, level by level."""

    def __init__(self, values: list[str], start: int, total: int, beside: dict[tuple[int, int], str]):
        self.levels: list[tuple[int, list[str]]] = []
        lo, nodes = start, values
        while total > 1:
            hi = lo + len(nodes)
            first, last = lo - lo % FANOUT, min(total, (hi - 1) // FANOUT * FANOUT + FANOUT)
            level = len(self.levels)
            row = [beside[level, i] for i in range(first, lo)] + nodes + [beside[level, i] for i in range(hi, last)]
            self.levels.append((first, row))
            nodes = [digest(*row[i : i + FANOUT]) for i in range(0, len(row), FANOUT)]
            lo, total = first // FANOUT, -(-total // FANOUT)
        self.top = nodes[0]
        self.kept: list[tuple[int, list]] = [(-1, [])] * (len(self.levels) + 1)

    def steps(self, idx: int, level: int = 0) -> list[tuple[str, str]]:
        if level == len(self.levels):
            return []
        at, steps = self.kept[level]
        if at != idx:
            first, row = self.levels[level]
            run = idx - idx % FANOUT - first
            own = ("".join(row[run : idx - first]), "".join(row[idx - first + 1 : run + FANOUT]))
            steps = [own, *self.steps(idx // FANOUT, level + 1)]
            self.kept[level] = (idx, steps)
        return steps


def folded(value: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        value = digest(left, value, right)
    return value


STEPS = "array<struct<left: string, right: string>>"


def _climbs(rows: pa.Table, context: pa.Table) -> Iterator[tuple[dict, Climb, dict[str, list]]]:
    """(context of a tag, its climb, its columns) in a stretch, tags in order."""
    own, beside = {}, {}
    for r in context.to_pylist():
        if r["level"] is None:
            own[r["tag"]] = r
        else:
            beside.setdefault(r["tag"], {})[r["level"], r["idx"]] = r["digest"]
    rows = rows.sort_by("row")
    columns = {c: rows[c].to_pylist() for c in rows.column_names}
    tags, at = columns["tag"], 0
    while at < len(tags):
        tag, n = tags[at], own[tags[at]]["here"]
        part = {c: v[at : at + n] for c, v in columns.items()}
        yield own[tag], Climb(part["leaf"], own[tag]["start"], own[tag]["total"], beside.get(tag, {})), part
        at += n


def _source_paths(rows: pa.Table, context: pa.Table) -> pa.Table:
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])
    schema = pa.schema([("source_tag", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("steps", pa.list_(pair))])
    out = []
    for own, climb, part in _climbs(rows, context):
        for i, (tag, value) in enumerate(zip(part["source_tag"], part["leaf"], strict=True)):
            out.append((tag, value, climb.top, [{"left": a, "right": b} for a, b in climb.steps(own["start"] + i)]))
    return _table(out, schema)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _doc_proofs(rows: pa.Table, context: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])
    out = []
    for own, climb, part in _climbs(rows, context):
        over = [(s["left"], s["right"]) for s in own["steps"]]
        last = "".join(a + b for a, b in over)
        for i, (doc_id, value, claimed) in enumerate(zip(part["doc_id"], part["leaf"], part["claimed"], strict=True)):
            steps = climb.steps(own["start"] + i)
            proof = digest(*[x for s in steps for x in s], last)
            out.append((doc_id, value, climb.top, own["root"], proof, folded(folded(claimed, steps), over)))
    return _table(out, schema)


def _with_context(f: Forest, more: DataFrame | None = None) -> DataFrame:
    """Of each stretch, in one frame: its runs, with columns of `more` (by tag), and the border nodes it needs."""
    runs = f.runs if more is None else f.runs.join(more, "tag")
    return runs.unionByName(_needs(f), allowMissingColumns=True)


class Manifest(NamedTuple):
    """documents: the forest of rows by source; sources: source_tag, subroot, root, steps."""

    documents: Forest
    sources: DataFrame

    def nodes(self) -> DataFrame:
        """tag, level, idx, digest of every node above the leaves, of every source's tree."""
        return self.documents.nodes


def manifest(docs: DataFrame, claimed: Column | None = None) -> Manifest:
    """The trees of documents (doc_id, source, lang, n_chars, text) by source and the tree of sources.

    Nulls are values of their own: a null source is a source, before all others; rows go by doc_id, null first, rows of equal id by leaf. Repeated rows are
    leaves each. Empty and very long texts are hashed whole. `claimed`: the leaf that somebody brings in place of each row's own. Other columns don't count. An empty table has no root.
    """
    ship(docs.sparkSession)
    own = leaf(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], docs["text"])
    leaves = written(docs.select(source_tag().alias("tag"), docs["doc_id"].cast("long").alias("doc_id"), own.alias("leaf"), (own if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("given")), "merkle-leaves")
    trees = forest(leaves, [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("given")])
    discard(leaves)
    tops = written(trees.tops.select(F.lit("").alias("tag"), F.col("tag").alias("source_tag"), F.col("top").alias("leaf")), "merkle-subroots")
    over = forest(tops, [F.asc("source_tag")])
    paths = over.rows.groupBy("part").cogroup(_with_context(over).groupBy("part")).applyInArrow(_source_paths, f"source_tag string, subroot string, root string, steps {STEPS}")
    return Manifest(trees, written(paths, "merkle-sources"))


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of every row; folded_root is made from the claimed leaf and the row's own siblings."""
    more = m.sources.select(F.col("source_tag").alias("tag"), "root", "steps")
    f = m.documents
    return f.rows.groupBy("part").cogroup(_with_context(f, more).groupBy("part")).applyInArrow(_doc_proofs, PROOFS)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.when(fold("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), tampered)
    return proofs(manifest(docs, claimed)).withColumn("verified", F.col("folded_root") == F.col("root"))
