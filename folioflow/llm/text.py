"""Vectorised text primitives on Arrow buffers: byte slices, words, word hashes, shingle hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit: a polynomial of
random byte values modulo 2**64 over the run, finalised together with its length. Such sums are weak on long runs made for it
(Thue-Morse words of 1,024 bytes agree for any odd base), so words and lines of more than LONG bytes get BLAKE2b.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is worked on alone.
CHUNK_BYTES = 1 << 20

#: Bytes of a run that the polynomial alone may stand for.
LONG = 64
BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 20240607


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.default_rng(_SEED).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls of ordinary size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 65536), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes of text: (rows, bytes, offsets). Whole texts always."""
    at = batch.schema.get_field_index(column)
    buf, offsets = text_buffers(batch.column(at))
    row, n = 0, batch.num_rows
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1), row + 4096)
        yield batch.slice(row, end - row), buf[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = np.zeros(len(buf) + 1, bool)
    solid[:-1] = ~is_space(buf)
    begins = solid[:-1].copy()
    begins[1:] &= ~solid[:-2]
    inner = offsets[1:-1]
    cut = inner[inner < len(buf)]
    begins[cut] = solid[cut]  # a text's first byte starts a word of its own
    starts = np.flatnonzero(begins)
    stops = solid[:-1] & ~solid[1:]
    last = cut[cut > 0] - 1
    stops[last] = solid[last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(buf: np.ndarray, base: int = BASE) -> np.ndarray:
    """Running polynomial sums: the hash of [s, e) is (p[e] - p[s]) * base**-s."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte_values()[buf] * powers(len(buf), base), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    inverse = powers(len(prefix), pow(base, -1, 1 << 64))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def run_hashes(buf: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run: `span_hash`, of long ones BLAKE2b."""
    out = span_hash(prefix, starts, ends)
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        out[long] = [int.from_bytes(blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word)."""
    starts, ends, first = words(buf, offsets)
    return run_hashes(buf, prefix_hash(buf), starts, ends), first


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of each run of `size` words; len(hashes) - size + 1 values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes. A text of fewer than `size` words is one shingle, one of no words none."""
    grams = combine(hashes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield combine(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def code_points(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    return segment_sums((buf & 0xC0) != 0x80, offsets)


def segment_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def replaced(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of `schema`: columns given here, others by name from `batch`."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in schema], schema=schema
    )
