"""Removal of every byte covered by a long string that also starts elsewhere, by suffix arrays.

Every LENGTH-byte window of a text is given to an anchor, the GRAM-byte string in it of least hash; equal
windows have equal anchors. Neighbouring windows of one anchor make a segment. An anchor that occurs once
leaves nothing equal. The distinct segments of the others, each with the number of its occurrences, are
laid end to end, anchor by anchor, in blocks of bounded size, and each block is sorted in two stages:
suffixes smaller than their successors directly, the rest induced from them by one scan over the buckets
of first bytes. Windows whose adjacent common prefixes reach LENGTH are equal.

An anchor with more than MOST distinct segments is too much for a block (a line that very many texts
have). Its segments are cut into chunks of WIDTHS[0] neighbouring windows; the bytes that all windows of
a chunk cover, with the anchor and the chunk's place beside it, are the chunk's own anchor, so equal
windows meet again, among far fewer. What is still too much is cut to the next width, at last to single
windows, of which equal ones alone meet. Each width is sorted like the first: every removed byte comes
from a suffix array, and no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import arrow_schema, discard, documents, own_name, ship, written
from folioflow.llm.text import CHUNK_BYTES, mix, prefix_hash, slices, span_hash

LENGTH, GRAM = 400, 50
WINDOW = LENGTH - GRAM + 1
#: Distinct segments of an anchor that are sorted together; bytes of a block.
MOST, BLOCK = 512, 1 << 18
#: Windows of a chunk, where an anchor has more: each width is for what the one before leaves too large.
WIDTHS = (100, 25, 5, 1)
#: Bytes of a longer text that are cut into segments at once: a task takes some hundred bytes of memory for each.
PIECE = CHUNK_BYTES
#: Bytes of the longest segment; of a page, from which the segments that start in it are cut (at least the former).
SEGMENT, PAGE = WINDOW + LENGTH - 1, 1 << 14
SECOND = 0xC2B2AE3D27D4EB4F
_POSITION = np.uint64((1 << 28) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from minima of block heads and tails."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(-1, width)
    heads = np.minimum.accumulate(table, axis=1).reshape(-1)
    tails = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tails[: n - width + 1], heads[width - 1 : n])


def segments(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, windows, lead, anchor hash, two hashes of the content) of every segment; start in its text, the anchor `lead` bytes on."""
    none = (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 3)
    if len(buf) < LENGTH:
        return none
    starts = np.arange(len(buf) - LENGTH + 1)
    long = np.diff(offsets) >= LENGTH
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(edge)[: len(starts)])
    if not len(valid):
        return none
    prefix = prefix_hash(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    least = sliding_min((gram & ~_POSITION) | at.astype(np.uint64), WINDOW)
    anchor = (least[valid] & _POSITION).astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    start = valid[first]
    windows = np.diff(np.append(first, len(valid)))
    end = start + windows - 1 + LENGTH
    text = np.searchsorted(offsets, start, side="right") - 1
    return text, start - offsets[text], windows, anchor[first] - start, gram[anchor[first]], span_hash(prefix, start, end), span_hash(prefix_hash(buf, SECOND), start, end, SECOND)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_LONG, _INT = T.LongType(), T.IntegerType()
#: Whose bytes a segment is cut from: a text, or a segment of the width before.
OWNER, UNIT = ["p1", "p2", "p3"], ["anchor", "h1", "h2"]
SEGMENTS = _struct(p1=_LONG, p2=_LONG, p3=_LONG, start=_LONG, windows=_INT, lead=_INT, anchor=_LONG, h1=_LONG, h2=_LONG, n=_LONG)


def _segment_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(SEGMENTS)
    for batch in batches:
        for rows, buf, offsets in slices(batch):
            # a text of more than a piece comes alone; windows belong to the piece in which they start
            for at in range(0, max(1, len(buf)), PIECE) if len(offsets) == 2 else [0]:
                part, cuts = (buf[at : at + PIECE + LENGTH - 1], None) if len(offsets) == 2 else (buf, offsets)
                text, start, windows, lead, anchor, h1, h2 = segments(part, np.array([0, len(part)]) if cuts is None else cuts)
                if len(text):
                    take = pa.array(text)
                    zero = np.zeros(len(text), np.int64)
                    columns = [rows["p1"].take(take), rows["p2"].take(take), pa.array(zero), pa.array(start + at), pa.array(windows, pa.int32()), pa.array(lead, pa.int32()), *(pa.array(x.view(np.int64)) for x in (anchor, h1, h2)), pa.array(zero + 1)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)


def chunks(contents: list[bytes], windows: np.ndarray, lead: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(segment, start, windows, lead, anchor, two hashes) of the chunks of these segments.

    A window's place is its anchor's offset in it, equal for equal windows; a chunk holds `width` neighbouring places.
    """
    buf = np.frombuffer(b"".join(contents), np.uint8)
    begin = np.cumsum([0] + [len(c) for c in contents])[:-1]
    low, high = (lead - windows + 1) // width, lead // width
    count = high - low + 1
    owner = np.repeat(np.arange(len(contents)), count)
    place = high[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    start = lead[owner] - np.minimum(place * width + width - 1, lead[owner])
    last = lead[owner] - np.maximum(place * width, (lead - windows + 1)[owner])
    core = begin[owner] + lead[owner] - place * width
    a, z = begin[owner] + start, begin[owner] + last + LENGTH
    one, two = prefix_hash(buf), prefix_hash(buf, SECOND)
    key = mix(anchor[owner] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ span_hash(one, core, core + LENGTH + 1 - width)
    return owner, start, last - start + 1, lead[owner] - start, mix(key), span_hash(one, a, z), span_hash(two, a, z, SECOND)


PAGES = _struct(p1=_LONG, p2=_LONG, p3=_LONG, page=_LONG, bytes=T.BinaryType())


def _page_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of texts that have segments, each with the bytes beyond that its last segment may take: a segment is cut from few bytes, however long the text."""
    schema = arrow_schema(PAGES)
    for batch in batches:
        for rows, buf, offsets in slices(batch):
            size = np.diff(offsets)
            count = np.where(size >= LENGTH, -(-size // PAGE), 0)
            owner = np.repeat(np.arange(len(size)), count)
            page = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            a = offsets[owner] + page * PAGE
            z = np.minimum(a + PAGE + SEGMENT - 1, offsets[owner + 1])
            raw, take = buf.tobytes(), pa.array(owner)
            content = pa.array([raw[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows["p1"].take(take), rows["p2"].take(take), pa.array(np.zeros(len(owner), np.int64)), pa.array(page), content], schema=schema)


def _chunk_rows(width: int):
    schema = arrow_schema(SEGMENTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                whole_numbers = [batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("windows", "lead", "anchor")]
                owner, start, windows, lead, *keys = chunks(batch["content"].to_pylist(), whole_numbers[0], whole_numbers[1], whole_numbers[2].view(np.uint64), width)
                take = pa.array(owner)
                columns = [*(batch[c].take(take) for c in UNIT), pa.array(start), pa.array(windows, pa.int32()), pa.array(lead, pa.int32()), *(pa.array(x.view(np.int64)) for x in keys), batch["n"].take(take)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Suffixes of `data` in order of at least their first `depth` bytes, by two-stage sorting.

    Stage one sorts the suffixes smaller than their successors. Stage two scans the buckets of first bytes
    in ascending order: a suffix in the bucket places the one before it, if that is larger than its
    successor, at the head of its own bucket. A bucket is scanned as whole arrays; only runs of one
    byte take a round for each of their bytes.
    """
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    changes = np.flatnonzero(x[:-1] != x[1:])
    at = np.searchsorted(changes, np.arange(n))
    small = np.zeros(n, bool)
    inner = at < len(changes)
    c = changes[at[inner]]
    small[inner] = x[c] < x[c + 1]

    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: data[i : i + depth]), np.int64)
    bounds = np.searchsorted(x[direct], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray, bucket: int) -> np.ndarray:
        """Place what precedes these suffixes; return those of this very bucket."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        byte = x[before]
        same = byte == bucket
        rest, byte = before[~same], byte[~same]
        if len(rest):
            order = np.argsort(byte, kind="stable")
            rest, byte = rest[order], byte[order]
            cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for part, b in zip(np.split(rest, cuts), byte[np.concatenate([[0], cuts])].tolist(), strict=True):
                heads[b].append(part)
        return before[same]

    heads[x[n - 1]].append(np.array([n - 1]))  # the last suffix is larger than the empty one
    out = []
    for b in range(256):
        todo = heads[b]
        while todo:
            found = np.concatenate(todo)
            out.append(found)
            more = induce(found, b)
            todo = [more] if len(more) else []
        part = direct[bounds[b] : bounds[b + 1]]
        if len(part):
            out.append(part)
            induce(part, b)
    return np.concatenate(out)


def common_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it, up to `most` (a multiple of 8)."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    padded = np.frombuffer(data + bytes(most + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + most, 8), (1, 1)).copy().view(">u8").reshape(-1)
    a, b, live = order[:-1], order[1:], np.arange(1, len(order))
    for at in range(0, most, 8):
        differ = words[a + at] ^ words[b + at]
        equal = differ == 0
        ended = ~equal
        if ended.any():
            bytes_ = differ[ended].astype(">u8").view(np.uint8).reshape(-1, 8)
            lcp[live[ended]] = at + np.argmax(bytes_ != 0, axis=1)
            a, b, live = a[equal], b[equal], live[equal]
        if not len(live):
            break
    lcp[live] = most
    return lcp


def repeated_windows(units: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """For each distinct segment (bytes, how often it occurs) the window starts whose LENGTH bytes start elsewhere too."""
    data = b"\xff".join(u for u, _ in units)
    begin = np.cumsum([0] + [len(u) + 1 for u, _ in units])[:-1]
    count = np.array([n for _, n in units])
    windows = np.array([len(u) - LENGTH + 1 for u, _ in units])
    owner = np.full(len(data), -1, np.int64)
    for k, (b, w) in enumerate(zip(begin.tolist(), windows.tolist(), strict=True)):
        owner[b : b + w] = k
    order = suffix_array(data, LENGTH)
    order = order[owner[order] >= 0]
    run = np.cumsum(common_prefixes(data, order, LENGTH) < LENGTH) - 1
    weight = np.bincount(run, weights=count[owner[order]])
    hit = np.sort(order[weight[run] >= 2])
    return [hit[a:z] - b for b, a, z in zip(begin.tolist(), np.searchsorted(hit, begin).tolist(), np.searchsorted(hit, begin + windows).tolist(), strict=True)]


_SPAN = T.ArrayType(_struct(first=_LONG, last=_LONG))
RUNS = _struct(anchor=_LONG, h1=_LONG, h2=_LONG, runs=_SPAN)


def _run_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, in order of their anchors, to the runs of repeated windows in each; whole anchors are gathered to blocks."""
    schema = arrow_schema(RUNS)

    def rows():
        for b in batches:
            yield from zip(*(b[c].to_pylist() for c in (*UNIT, "n", "content")), strict=True)

    def flush(block: list[tuple]) -> pa.RecordBatch:
        out = []
        for (anchor, h1, h2, _, _), hit in zip(block, repeated_windows([(u[4], u[3]) for u in block]), strict=True):
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                ends = zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True)
                out.append((anchor, h1, h2, [{"first": a, "last": z} for a, z in ends]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    block, size = [], 0
    for _, group in groupby(rows(), key=lambda r: r[0]):
        group = list(group)
        more = sum(len(r[4]) for r in group)
        if block and size + more > BLOCK:
            yield flush(block)
            block, size = [], 0
        block += group
        size += more
    if block:
        yield flush(block)


def _keys() -> list[Column]:
    """What tells rows apart: rows equal in both are equal in all that counts."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("p1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("p2")]


def repeated_runs(cut: DataFrame, sources: DataFrame, widths: tuple[int, ...], most: int) -> DataFrame:
    """p1, p2, p3, runs: the runs of repeated windows in each segment of `cut`, whose bytes are in `sources` (p1, p2, p3, page, bytes).

    Every join is between tables and plain exchanges, so that one with a very common key is split.
    """
    depth = f"suffix{len(WIDTHS) - len(widths)}"
    shared = written(cut.groupBy("anchor").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor"), f"{depth}-shared")
    met = written(cut.join(shared, "anchor"), f"{depth}-met")
    units = met.groupBy(*UNIT).agg(F.sum("n").alias("n"), F.min(F.struct(*OWNER, "start", "windows", "lead")).alias("at"))
    units = written(units, f"{depth}-units")
    crowd = written(units.groupBy("anchor").count(), f"{depth}-crowd")
    content = F.expr(f"substring(bytes, cast(at.start % {PAGE} + 1 as int), at.windows + {LENGTH - 1})")
    page = F.expr(f"at.start div {PAGE}").alias("page")
    spelled = units.join(crowd, "anchor").select("*", *[F.col(f"at.{p}").alias(p) for p in OWNER], page).join(sources, [*OWNER, "page"])
    spelled = written(spelled.select(*UNIT, "n", "count", "at.windows", "at.lead", content.alias("content")), f"{depth}-spelled")
    discard(shared, units, crowd)

    few = spelled.filter(F.col("count") <= most) if widths else spelled
    found = few.select(*UNIT, "n", "content").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_run_rows, RUNS)
    many = spelled.filter(F.col("count") > most)
    if widths and many.limit(1).count():
        finer = written(many.mapInArrow(_chunk_rows(widths[0]), SEGMENTS), f"{depth}-chunks")
        below = repeated_runs(finer, many.select(*[F.col(u).alias(p) for u, p in zip(UNIT, OWNER, strict=True)], F.lit(0).cast("long").alias("page"), F.col("content").alias("bytes")), widths[1:], most)
        found = found.unionByName(below.select(*[F.col(p).alias(u) for u, p in zip(UNIT, OWNER, strict=True)], "runs"))
    found = written(found, f"{depth}-runs")
    shifted = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"]).alias("last")))
    # rows repeated have the same runs: one set of them is kept
    return met.join(found, UNIT).select(*OWNER, shifted.alias("runs")).groupBy(*OWNER).agg(F.flatten(F.collect_set("runs")).alias("runs"))


def covered(docs: DataFrame, most: int = MOST) -> DataFrame:
    """p1, p2, p3, runs: runs of window starts, in bytes, that are repeated."""
    ship(docs.sparkSession)
    cut = written(docs.select(*_keys(), "text").mapInArrow(_segment_rows, SEGMENTS), "suffix-segments")
    pages = docs.select(*_keys(), "text").mapInArrow(_page_rows, PAGES)
    # a row repeated must not give its segments once more
    return repeated_runs(cut, pages.dropDuplicates([*OWNER, "page"]), WIDTHS, most)


CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


@F.arrow_udf(CUT)
def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The structs of CUT, for about a megabyte of text at a time."""
    schema = pa.struct(list(arrow_schema(CUT)))
    for text, runs in batches:
        for rows, _, _ in slices(pa.RecordBatch.from_arrays([text, runs], ["text", "runs"])):
            out = []
            for t, rs in zip(rows["text"].to_pylist(), rows["runs"].to_pylist(), strict=True):
                raw, spans = (t or "").encode(), []
                for first, last in sorted((r["first"], r["last"]) for r in rs or ()):
                    if spans and first <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], last + LENGTH)
                    else:
                        spans.append({"start": first, "end": last + LENGTH})
                parts, at = [], 0
                for s in spans:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                out.append({"n_bytes": len(raw), "spans": spans, "kept": b"".join([*parts, raw[at:]])})
            yield pa.array(out, schema)


def remove_repeats(docs: DataFrame, name: str = "cut", most: int = MOST) -> DataFrame:
    """`docs` with a struct: n_bytes, spans (maximal removed runs of bytes), kept (the bytes that remain).

    A byte goes that is covered by a LENGTH-byte string that also starts anywhere else, in the same text or
    another, judged on the input. Null text counts as empty; texts shorter than LENGTH keep all; texts of any
    length are cut in pieces of bounded size. Rows repeated are each other's copies; ties of hashes only gather
    more for one sort. Extra columns pass through; a column of that name is replaced. An empty table gives an
    empty one.
    """
    k1, k2, r = (own_name(docs, x) for x in ("p1", "p2", "runs"))
    # written, so that the rows of one id and text, however many, are split in the join
    runs = written(covered(docs, most), "suffix-covered").select(F.col("p1").alias(k1), F.col("p2").alias(k2), F.col("runs").alias(r))
    a, b = _keys()
    joined = docs.withColumns({k1: a, k2: b}).join(runs, [k1, k2], "left")
    return joined.withColumn(name, _cut.asNondeterministic()("text", r)).drop(k1, k2, r)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "cut")
    removed = F.aggregate("cut.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return cut.select("doc_id", "cut.n_bytes", removed.alias("n_removed"), F.size("cut.spans").cast("long").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256"))
