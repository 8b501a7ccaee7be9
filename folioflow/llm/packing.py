"""Packing documents into token sequences of balanced cost.

A document's ids are cut into whole sequences as far as they go. The remainders of a block of documents
are dealt out by cost: each has an estimated attention cost, linear plus quadratic in its length; in
descending order each goes to the sequence of lowest cost so far that still has room for it. What fits
nowhere whole is cut over the sequences with the most room. Blocks are packed where their rows are
read: no row moves, and a block's ids are all that a task holds.
"""

from __future__ import annotations

import heapq
import re
import zlib
from base64 import b64decode
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from folioflow.llm.common import arrow_schema, documents, ship
from folioflow.llm.text import slices

LENGTH = 2048
END = 1
#: Tokens of a block, beyond which it is packed.
BLOCK = 1 << 20
#: Cost of a document of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 1024
VOCABULARY = "byte_bpe_50k"
#: Pretokens and their ids that a worker keeps at once; it starts anew beyond.
MEMO = 300_000


class Tokenizer:
    """Ids of the byte-level BPE vocabulary, as two-byte numbers.

    Where a text holds only characters of which `re` and the vocabulary's pattern hold the same view, it
    is split by `re` and the ids of each piece are remembered; other texts go through the library whole.
    """

    #: Fixed value: the vocabulary's pattern, in the terms of `re`.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    #: Beyond U+024F, numbers that aren't digits, and control characters that are blanks to one side alone.
    OTHER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines())
        self.slow = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.memo: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        if self.OTHER.search(text):
            return np.array(self.slow.encode_ordinary(text), np.uint16)
        memo = self.memo
        pieces = self.SPLIT.findall(text)
        new = [p for p in set(pieces) if p not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set(pieces))
        for p in new:
            memo[p] = np.array(self.slow.encode_ordinary(p), np.uint16).tobytes()
        return np.frombuffer(b"".join([memo[p] for p in pieces]), np.uint16)


@lru_cache(maxsize=1)
def tokenizer(ranks: bytes) -> Tokenizer:
    """A worker's tokenizer, kept over its tasks."""
    return Tokenizer(ranks)


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


def plan(lengths: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths, sequences from 0.

    Every id lies in one piece; every sequence but at most one is full.
    """
    out, rest, sequences = [], [], 0
    for d, n in enumerate(lengths):
        whole = n - n % LENGTH
        for start in range(0, whole, LENGTH):
            out.append((d, start, LENGTH, sequences, 0))
            sequences += 1
        if n > whole:
            rest.append((n - whole, d, whole))
    total = sum(n for n, _, _ in rest)
    count = -(-total // LENGTH)
    size = [LENGTH] * count
    if total % LENGTH:
        size[-1] = total % LENGTH  # so that the others are full
    used = [0] * count
    # lengths descend, so a sequence with room for one document has it for all later ones: it waits by room
    # until a document fits, then by cost until it is chosen
    waiting, fit, spare = [(-z, s) for s, z in enumerate(size)], [], []
    heapq.heapify(waiting)
    spent = [0.0] * count
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(fit, (spent[s], s))
        if not fit:
            spare.append((n, d, start))
            continue
        s = heapq.heappop(fit)[1]
        out.append((d, start, n, sequences + s, used[s]))
        used[s] += n
        spent[s] += cost(n)
        if used[s] < size[s]:
            heapq.heappush(waiting, (used[s] - size[s], s))
    room = sorted((s for s in range(count) if used[s] < size[s]), key=lambda s: (used[s] - size[s], s))
    for n, d, start in spare:
        while n:
            s = room[0]
            k = min(n, size[s] - used[s])
            out.append((d, start, k, sequences + s, used[s]))
            used[s], start, n = used[s] + k, start + k, n - k
            if used[s] == size[s]:
                room.pop(0)
    return out


def in_order(pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """`pieces` with their sequences numbered in the order of the documents of which they hold most."""
    lead: dict[int, tuple[int, int, int]] = {}
    for d, start, n, s, _ in pieces:
        lead[s] = min(lead.get(s, (0, 0, 0)), (-n, d, start))
    place = {s: i for i, s in enumerate(sorted(lead, key=lambda s: lead[s][1:]))}
    return [(d, start, n, place[s], offset) for d, start, n, s, offset in pieces]


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
WITH_IDS = T.StructType([*PIECES, T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _packer(ranks: bytes, schema: T.StructType):
    arrow = arrow_schema(schema)

    def flush(held: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        rows, most = [], 0
        for d, start, n, s, offset in in_order(plan([len(ids) for _, ids in held])):
            doc_id, ids = held[d]
            part = ids[start : start + n].astype("<u4")
            rows.append((doc_id, start, n, zlib.crc32(part.tobytes()), len(ids), first + s, offset, part))
            most = max(most, s + 1)
        columns = [[r[i] for r in rows] for i in range(len(schema))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), first + most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks).ids
        first = TaskContext.get().partitionId() << 40
        held, tokens = [], 0
        for batch in batches:
            for rows, buf, offsets in slices(batch):
                raw = buf.tobytes()
                for doc_id, a, b in zip(rows["doc_id"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    ids = np.append(encode(raw[a:b].decode()), np.uint16(END))
                    held.append((doc_id, ids))
                    tokens += len(ids)
                    if tokens >= BLOCK:
                        out, first = flush(held, first)
                        yield out
                        held, tokens = [], 0
        if held:
            yield flush(held, first)[0]

    return run


def pack(docs: DataFrame, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: the ids too.

    Null or empty text is the end id alone. Repeated rows are packed each for itself; a null doc_id stays
    null. Sequences are numbered by partition and block, in a block in the order of its rows, so `docs` must give a partition the same rows in the
    same order when a task is run again, as any table read from files does. An empty table gives no piece. Texts of any length are
    packed whole; documents of equal length go in the order of their rows. Of further columns of `docs` none is kept.
    """
    ship(docs.sparkSession)
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = f.read()
    schema = WITH_IDS if with_ids else PIECES
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_packer(ranks, schema), schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
