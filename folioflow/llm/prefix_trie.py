"""The prefix trie of conversations by partition refinement.

All conversations start as one class, the root. A class is split by its members' next turns; each part is a
node and the class of the next depth. A class of one is retired: its tail is a chain of nodes, emitted as it
stands. Large classes are split a turn at a time by Spark, all of one depth together; a class with few turns
left is refined to its end in one task, many classes after another. Then counts are folded back from the
deepest nodes to the root.

A turn is told by the SHA-256 of its role and text, so texts move once at most and only digests are shuffled
after. Every step is an aggregate or an equal join; nothing collects a class, and a node's member list is
hashed as it streams by in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import arrow_schema, discard, ship, written

#: Turns that a class may still have for one task to refine it.
LOCAL = 1024
#: Turns that a rebuilt conversation may take over, plus one; conversations of a block share its first.
HEAD, BLOCK = 9, 5

NODES = T.StructType([T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [T.StructField("ends_sha256", T.StringType())])
NONE = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, key, bytes: turns in order (null first; of equal turns by role, then by digest), numbered from 0.

    Rows are sorted over ranges, so that no conversation, however long, has to lie in one task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    thin = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    thin = written(thin, "trie-thin")
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("key"), F.asc("row")]
    dealt = thin.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    dealt = written(dealt.select("conv_id", F.shiftright("row", 33).alias("part"), "row", "key", "bytes"), "trie-sorted")
    runs = dealt.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a conversation lies in
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    out = written(dealt.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("row") + F.col("shift")).alias("at"), "key", "bytes"), "trie-turns")
    discard(thin, dealt)
    return out


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of conversations that open with the first turns of their block's first one: conv_id, at, key, bytes; conv_id, length."""
    c = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = c.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    bases = c.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    c = c.join(bases, "base", "left").withColumn("borrowed", F.least("h", F.coalesce("n_base", F.lit(0))))
    c = written(c.select("conv_id", "h", "base", "borrowed", (F.col("borrowed") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "trie-conversations")
    kept = own.join(c.select("conv_id", "h", "borrowed"), "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("borrowed")).alias("at"), "key", "bytes")
    heads = own.filter(F.col("at") < HEAD - 1).withColumnRenamed("conv_id", "base")
    taken = heads.join(c.select("conv_id", "base", "h"), "base").filter("at < h").select("conv_id", "at", "key", "bytes")
    return written(kept.unionByName(taken), "trie-rebuilt"), c.select("conv_id", "length")


def _refined(top: int, depth: int, members: list[tuple[int, list[bytes], list[int]]]) -> list[list]:
    """Nodes below a class by refinement, its own first (whose savings and ends are not told here). Members ascend: (conv_id, keys, bytes) of the turns from `depth` on."""
    nodes: list[list] = [[top, depth, None, len(members), 0, 0, 0, None]]
    ends: list[list[int]] = [[]]
    parent, active = [-1], [(0, 0, list(range(len(members))))]

    def add(under: int, at: int, conv: int, n: int, size: int) -> int:
        nodes.append([conv, depth + at, nodes[under][0], n, 0, 0, (n - 1) * size, None])
        parent.append(under)
        ends.append([])
        return len(nodes) - 1

    while active:
        node, at, held = active.pop()
        parts: dict[bytes, list[int]] = {}
        for m in held:
            conv, keys, _ = members[m]
            if len(keys) > at:
                parts.setdefault(keys[at], []).append(m)
            else:
                ends[node].append(conv)
        for part in parts.values():
            conv, keys, sizes = members[part[0]]
            new = add(node, at + 1, conv, len(part), sizes[at])
            if len(part) > 1:
                active.append((new, at + 1, part))
                continue
            for i in range(at + 1, len(keys)):  # retired: the tail is a chain
                new = add(new, i + 1, conv, 1, sizes[i])
            ends[new].append(conv)
    for i in range(len(nodes) - 1, -1, -1):
        row = nodes[i]
        if not row[4]:
            row[5] = 1
        row[7] = hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest()
        if i:
            up = nodes[parent[i]]
            up[4], up[5], up[6] = up[4] + 1, up[5] + row[5], up[6] + row[6]
    return nodes


def _refine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, depth, conv_id, at, key, bytes) in this order, classes whole: a class at a time is held."""
    schema = arrow_schema(NODES)
    out: list[list] = []
    cls, members = None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for b in batches:
        for node, depth, conv, key, size in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
            if (node, depth) != cls:
                if cls is not None:
                    out += _refined(*cls, members)
                    if len(out) > 50_000:
                        yield batch()
                        out = []
                cls, members = (node, depth), []
            if not members or members[-1][0] != conv:
                members.append((conv, [], []))
            members[-1][1].append(key)
            members[-1][2].append(size)
    if cls is not None:
        out += _refined(*cls, members)
    yield batch()


def _end_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, depth, conv_id) in this order to a hash for each node: ids go by, none are held."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())])
    out: list[tuple] = []
    at, state = None, None
    for b in batches:
        for node, depth, conv in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (node, depth) != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (node, depth), hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, schema, strict=True)], schema=schema)
        out = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, state.hexdigest()), schema, strict=True)], schema=schema)


def trie(rows: DataFrame, conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie's nodes from turns (conv_id, at, key, bytes) and all conversations (conv_id, length), the turnless too.

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    No conversation, no node. `local`: turns up to which a class is refined in one task.
    """
    ship(rows.sparkSession)
    single, small = F.col("n") == 1, F.col("rest") <= local
    # the root: conv_id, depth, parent, n, rest (its members' turns still to come), bytes
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("rest")).filter("n > 0")
    groups = [written(root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n", "rest", F.lit(0).cast("long").alias("bytes")), "trie-root")]
    top_row = groups[0].first()
    if top_row is None:
        return rows.sparkSession.createDataFrame([], NODES)
    state = "single" if top_row.n == 1 else "small" if top_row.rest <= local else "large"
    members = [conversations.select("conv_id", F.lit(top_row.conv_id).alias("node"), "length", F.lit(state).alias("state"))]
    while not groups[-1].filter(~single & ~small).isEmpty():
        d = len(groups) - 1
        active = members[-1].filter("state = 'large'").select("conv_id", "node", "length")
        split = rows.filter(F.col("at") == d).select("conv_id", "key", "bytes").join(active, "conv_id")
        parts = split.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum(F.col("length") - (d + 1)).alias("rest"), F.max("bytes").alias("bytes"))
        parts = written(parts.select("conv_id", F.lit(d + 1).cast("long").alias("depth"), F.col("node").alias("parent"), "n", "rest", "bytes", "key"), "trie-parts")
        shared = parts.filter(~single).select(F.col("conv_id").alias("id"), F.col("parent").alias("node"), "key", F.when(small, "small").otherwise("large").alias("state"))
        members.append(written(split.join(shared, ["node", "key"]).select("conv_id", F.col("id").alias("node"), "length", "state"), "trie-members"))
        groups.append(parts.drop("key"))
    at_depth = lambda f: reduce(DataFrame.unionByName, [f(m, d) for d, m in enumerate(members)])

    # classes of one: the tails
    alone = reduce(DataFrame.unionByName, [g.filter(single).select("conv_id", "depth", "rest") for g in groups])
    last = F.col("at") + 1 == F.col("depth") + F.col("rest")
    own_hash = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = lambda df, depth, parent, ended: df.select("conv_id", depth.alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(ended, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(ended, own_hash).otherwise(NONE).alias("ends_sha256"))
    tails = chain(rows.join(alone, "conv_id").filter("at >= depth"), F.col("at") + 1, F.col("conv_id"), last)
    heads = reduce(DataFrame.unionByName, [chain(g.filter(single & (F.col("depth") > 0)), F.col("depth"), F.col("parent"), F.col("rest") == 0) for g in groups])

    # small classes: refined where their turns meet
    few = at_depth(lambda m, d: m.filter("state = 'small'").select("conv_id", "node", F.lit(d).cast("long").alias("depth")))
    held = rows.join(few, "conv_id").filter("at >= depth").select("node", "depth", "conv_id", "at", "key", "bytes")
    refined = written(held.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id", "at").mapInArrow(_refine, NODES), "trie-refined")
    top = F.col("parent_conv_id").isNull()

    # where members of shared classes end
    ended = at_depth(lambda m, d: m.filter(F.col("length") == d).select("node", F.lit(d).cast("long").alias("depth"), "conv_id"))
    ends = ended.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(_end_hashes, "conv_id long, depth long, ends string")

    # fold back: what lies below a shared class, from the deepest depth on
    below_small = refined.filter(top).select("conv_id", "depth", "n_children", "n_leaves", F.col("saved_tokens").alias("saved"))
    folded, below = [], None
    for g in reversed(groups):
        shared = g.filter(~single | (F.col("depth") == 0))
        known = shared.join(below_small, ["conv_id", "depth"], "left")
        if below is not None:
            known = known.join(below, "conv_id", "left").select(*shared.columns, *[F.coalesce(c, f"large_{c}").alias(c) for c in ("n_children", "n_leaves", "saved")])
        known = known.select(*shared.columns, F.coalesce("n_children", F.when(single & (F.col("rest") > 0), 1).otherwise(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("bytes")).alias("saved"))
        known = written(known, "trie-folded")
        folded.append(known)
        up = known.select("parent", "n_leaves", "saved").unionByName(g.filter(single & (F.col("depth") > 0)).select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
        below = up.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("large_n_children"), F.sum("n_leaves").alias("large_n_leaves"), F.sum("saved").alias("large_saved"))
    joined = reduce(DataFrame.unionByName, folded).join(ends, ["conv_id", "depth"], "left")
    joined = joined.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))
    return reduce(DataFrame.unionByName, [joined, refined.filter(~top), heads, tails])


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (conv_id, turn, role, text); each opens with the first h turns of its block's first conversation, h being crc32(conv_id) mod 9.

    Null role and text count as empty, rows of a null conv_id belong to no conversation and are left out. Equal turns of a conversation go by role, then by the digest of role and
    text; repeated rows are turns of their own. Empty and very long texts are turns like others. Other columns are not read. An empty table gives no node.
    """
    rows, all_ = rebuilt(turns(conversations))
    return trie(rows, all_, local)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
