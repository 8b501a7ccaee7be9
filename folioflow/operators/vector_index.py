"""Dense search by matrix products over Arrow batches: exact, or by an inverted file of probed lists.

The inverted file: centroids by k-means over a bounded sample, every vector in the list of its nearest
centroid, lists as partitions of a table. A search goes to the lists nearest to each question, which the
scan finds by their folders; the exact search goes to all rows. Either way a task keeps its own best rows of each
question, so what moves is a few rows a task and question.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.operators.fusion import ranked
from folioflow.session import ship

#: Bytes of vectors, as four-byte numbers, that centroids are made from, and vectors of a list there at least.
SAMPLE_BYTES, EACH = 64 << 20, 20
STEPS, SEED = 12, 20240607
#: Questions whose vectors go to every task at once; more go in turns of so many.
TURN = 1000
#: Scores are told apart after nine places; a task keeps what may still tie.
MARGIN = 1e-8
#: Scores that are worked out at once.
PAIRS = 1 << 18


class Index(NamedTuple):
    path: str
    centroids: np.ndarray


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length, without nulls, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of unit vectors, the first centres drawn from the sample, the same each time; an empty list takes the vector farthest from its own."""
    rng = np.random.default_rng(SEED)
    c = sample[np.sort(rng.choice(len(sample), k, replace=False))]
    for _ in range(STEPS):
        near = sample @ c.T
        own = near.argmax(axis=1)
        far = np.argsort(near[np.arange(len(sample)), own], kind="stable")
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        sums[empty] = sample[far[: len(empty)]]
        c = unit(sums)
    return c


def _assigned(c: np.ndarray, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (unit(matrix(b["embedding"])) @ c.T).argmax(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], schema=schema)

    return run


def build(collection: DataFrame, path: str, lists: int | None = None) -> Index:
    """An inverted file of every row of `collection` (id, embedding, others) at `path`, in `lists` lists, about twice the root of the rows.

    Centroids are made from SAMPLE_BYTES of vectors at most, those of least hash of id, and there are never more lists than a sample's EACH-th; all rows are
    indexed. Vectors that are null or of another length than the least id's are an error. A crowded list, as of copies of one vector, is written by several tasks.
    """
    ship(collection.sparkSession)
    facts = collection.agg(F.count("*").alias("n"), F.min_by(F.size("embedding"), "id").alias("dim"), F.count_if(F.col("embedding").isNull()).alias("none"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if facts.n and (facts.none or facts.lo != facts.hi or facts.lo <= 0):
        raise ValueError("vectors are of one length, none is missing")
    most = max(1, SAMPLE_BYTES // (4 * max(facts.dim or 1, 1)))
    rows = collection.select("embedding").orderBy(F.xxhash64(F.col("id")), "id").limit(min(most, facts.n)) if facts.n > most else collection.orderBy("id").select("embedding")
    sample = unit(matrix(rows.toArrow()["embedding"])) if facts.n else np.zeros((0, 1))
    k = lists or max(1, round(2 * facts.n**0.5))
    c = centroids(sample, max(1, min(k, len(sample) // EACH or 1))) if facts.n else np.zeros((1, facts.dim or 1))
    schema = T.StructType([*collection.schema]).add("list", T.IntegerType())
    out = collection.mapInArrow(_assigned(c, to_arrow_schema(schema)), schema)
    out.hint("rebalance", "list").sortWithinPartitions("list").write.mode("errorifexists").partitionBy("list").parquet(path)
    return Index(path, c)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products along the last axis, added up in order of dimension: those of equal vectors are equal to the last bit, wherever they stand."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for k in range(x.shape[-1]):
        out += x[..., k] * y[..., k]
    return out


def _unscored(ids: pa.Array, asked: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each of these rows with each of these questions, without a score."""
    several = max(1, PAIRS // max(1, len(asked)))
    for at in range(0, len(ids) if len(asked) else 0, several):
        some = ids[at : at + several]
        twice = pa.array(np.repeat(np.arange(len(some)), len(asked)))
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(asked, len(some)).astype(np.int32)), some.take(twice), pa.nulls(len(twice), pa.float64())], schema=schema)


def _best(questions: np.ndarray, most: int | None, probes: np.ndarray | None, schema: pa.Schema, undefined: bool = False, without: int = 0):
    """Of each batch and question the rows that may be among the `most` best, or all. probes: lists x questions, whether a question goes to a list.

    `undefined`: as in `scores`; `without`: how many questions without a vector follow the others.
    """
    q, long = unit(questions), np.sqrt(_dots(questions, questions))

    def cosine(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = x[i], questions[j]
        n = np.sqrt(_dots(a, a)) * long[j]
        if undefined:
            with np.errstate(divide="ignore", invalid="ignore"):
                return _dots(a, b) / n
        return np.divide(_dots(a, b), n, out=np.zeros(n.shape), where=n > 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if undefined:
                there = b["embedding"].is_valid()
                yield from _unscored(b["id"].filter(pc.invert(there)), np.arange(len(q) + without), schema)
                b = b.filter(there)
                yield from _unscored(b["id"], np.arange(len(q), len(q) + without), schema)
                if not b.num_rows or not len(q):
                    continue
            x = matrix(b["embedding"])
            if probes is None:
                groups = [(np.arange(len(x)), np.arange(len(q)))]
            else:
                own = b["list"].to_numpy()
                groups = [(np.flatnonzero(own == at), np.flatnonzero(probes[at])) for at in np.unique(own)]
            for rows, asked in groups:
                if not len(asked):
                    continue
                if most is None or len(rows) <= most:
                    several = max(1, PAIRS // len(asked))
                    for at in range(0, len(rows), several):
                        r = rows[at : at + several]
                        score = cosine(x, r[:, None], asked[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(asked, len(r)).astype(np.int32)), b["id"].take(pa.array(np.repeat(r, len(asked)))), pa.array(score)], schema=schema)
                    continue
                near = unit(x[rows]) @ q[asked].T
                i, j = np.nonzero(near >= np.partition(near, len(rows) - most, axis=0)[len(rows) - most] - MARGIN)
                for at in range(0, len(i), PAIRS):
                    r, a = rows[i[at : at + PAIRS]], asked[j[at : at + PAIRS]]
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), b["id"].take(pa.array(r)), pa.array(cosine(x, r, a))], schema=schema)

    return run


def scores(rows: DataFrame, questions: DataFrame, most: int | None, index: Index | None = None, probe: int | None = None, undefined: bool = False) -> DataFrame:
    """query_id, id, score: cosines (0 for a zero vector, rounded to nine places) of each question's best rows, `most` and some more; None: of all rows.

    `index`: `rows` are read from it, and a question goes to its `probe` nearest lists; else all rows count. Rows whose vector is null or
    of another length than a question's have none.
    `undefined`, for whole lists: as in SQL, a zero vector's cosine is NaN, and a null vector, of a row or a question, makes a null score.
    """
    if undefined and (most is not None or index is not None):
        raise ValueError("undefined scores are for whole lists")
    spark = questions.sparkSession
    ship(spark)
    asked = questions.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = asked if undefined else asked.filter("vector IS NOT NULL")
    kind = rows.select("id").schema["id"].dataType
    number = T.StructType().add("q", T.IntegerType()).add("id", kind).add("score", T.DoubleType())
    out = None
    n = asked.count()
    for at in range(0, max(n, 1), TURN):
        turn = asked if n <= TURN else asked.orderBy("query_id").offset(at).limit(TURN)
        held = sorted(turn.collect(), key=lambda r: r.vector is None)  # TURN vectors at most
        if not held:
            break
        given = [r.vector for r in held if r.vector is not None]
        v = np.array(given, np.float64) if given else np.zeros((0, 0))
        fits = F.size("embedding") == v.shape[1] if given else F.lit(True)
        use, probes = rows.filter(fits | F.col("embedding").isNull() if undefined else fits), None
        if index is not None and probe is not None and probe < len(index.centroids):
            near = np.argsort(-(unit(v) @ index.centroids.T), axis=1, kind="stable")[:, :probe]
            probes = np.zeros((len(index.centroids), len(v)), bool)
            probes[near.T, np.arange(len(v))] = True
            use = use.filter(F.col("list").isin([int(i) for i in np.flatnonzero(probes.any(axis=1))]))
        columns = ["id", "embedding"] + (["list"] if probes is not None else [])
        found = use.select(*columns).mapInArrow(_best(v, most, probes, to_arrow_schema(number), undefined, len(held) - len(v)), number)
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(held)], T.StructType().add("q", T.IntegerType()).add("query_id", asked.schema["query_id"].dataType))
        part = found.join(F.broadcast(names), "q").select("query_id", "id", F.round("score", 9).alias("score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType().add("query_id", asked.schema["query_id"].dataType).add("id", kind).add("score", T.DoubleType()))
    return out


def topk(index: Index, questions: DataFrame, most: int, probe: int | None = None, where=None) -> DataFrame:
    """query_id, id, score, rank of each question's `most` best rows of an index; `probe` None is exact. `where`: DataFrame -> DataFrame, a filter on its rows."""
    rows = questions.sparkSession.read.parquet(index.path)
    rows = rows if where is None else where(rows)
    return ranked(scores(rows, questions, most, index, probe), ["query_id"], most)


#: Questions that lists are told by, at most, and the share of their best rows that is to be found.
TRIED, TARGET = 200, 0.95


def probes_for(index: Index, questions: DataFrame, most: int = 10, target: float = TARGET) -> int:
    """The fewest lists in which `target` of the best rows of some questions (TRIED at most, those of least hash) lie, by the exact search of these.

    Vectors in clusters need few lists; ones without any need a large share of them.
    """
    some = questions.orderBy(F.xxhash64(F.col("query_id").cast("string")), "query_id").limit(TRIED)
    rows = questions.sparkSession.read.parquet(index.path)
    best = topk(index, some, most).join(rows.select("id", "list"), "id").select("query_id", "list").collect()  # TRIED * most rows
    if not best:
        return 1
    held = {r.query_id: r.vector for r in some.select("query_id", F.col("vector").cast("array<double>").alias("vector")).collect()}
    near = {q: np.argsort(np.argsort(-(index.centroids @ unit(np.array([v]))[0]), kind="stable")) for q, v in held.items() if v is not None}
    places = np.sort([near[r.query_id][r.list] for r in best])
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1
