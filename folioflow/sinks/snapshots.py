"""Tables replaced whole or by key, and snapshots of several with a manifest."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.state import upserted

#: Names of a writing's folder, before its number: the whole table, or a layer of rows that take the place of those of their keys.
ROWS, OVER = "rows-", "over-"
#: A table is written whole again where its layers would be more than this, or weigh more than the rest of it.
MOST_LAYERS = 32


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Writing(NamedTuple):
    number: int
    at: str
    key: str | None  # of a layer
    done: bool


def _writings(spark: SparkSession, path: str) -> list[Writing]:
    """All writings of a table in order."""
    fs, top = _fs(spark, path)
    if not fs.exists(top):
        return []
    out = []
    for s in fs.listStatus(top):
        name, at = s.getPath().getName(), s.getPath().toString()
        if s.isDirectory() and name.startswith((ROWS, OVER)):
            number, _, key = name.removeprefix(ROWS).removeprefix(OVER).partition("-")
            out.append(Writing(int(number), at, key if name.startswith(OVER) else None, fs.exists(_fs(spark, f"{at}/_SUCCESS")[1])))
    return sorted(out, key=lambda w: w.number)


def _whole(writings: list[Writing]) -> list[Writing]:
    return [w for w in writings if w.done and w.key is None]


def _current(writings: list[Writing]) -> list[Writing]:
    """The newest writing of the whole table and the layers over it, of those that were written to their end."""
    whole = _whole(writings)
    return [w for w in writings if w.done and w.number >= whole[-1].number] if whole else []


def current(spark: SparkSession, path: str) -> list[str]:
    """The folders that a table's rows are read from."""
    return [w.at for w in _current(_writings(spark, path))]


def _delete(spark: SparkSession, writings: list[Writing]) -> None:
    for w in writings:
        fs, old = _fs(spark, w.at)
        fs.delete(old, True)


def _bytes(spark: SparkSession, writings: list[Writing]) -> int:
    total = 0
    for w in writings:
        fs, at = _fs(spark, w.at)
        total += fs.getContentSummary(at).getLength()
    return total


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table's rows: of each key those of the newest layer that has it, else those of the whole table."""
    parts = _current(_writings(spark, path))
    if len(parts) < 2:
        return spark.read.parquet(parts[0].at) if parts else None
    key = parts[1].key
    number = F.regexp_extract("_metadata.file_path", rf"/(?:{ROWS}|{OVER})(\d+)[^/]*/[^/]*$", 1).cast("long")
    rows = spark.read.parquet(*[w.at for w in parts])
    newest = spark.read.parquet(*[w.at for w in parts[1:]]).groupBy(key).agg(F.max(number).alias("__newest"))
    both = rows.select("*", number.alias("__number")).join(newest, key, "left")
    return both.filter(F.col("__newest").isNull() | (F.col("__newest") == F.col("__number"))).select(*rows.columns)


def _write(df: DataFrame, path: str, before: list[Writing], key: str | None = None) -> str:
    number = f"{before[-1].number + 1 if before else 0:012d}"
    at = f"{path}/{ROWS}{number}" if key is None else f"{path}/{OVER}{number}-{key}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(at)
    return at


def replace(df: DataFrame, path: str) -> None:
    """Write all rows of a table anew: `read` gives the old rows or the new, wherever this is stopped. `df` may read from `path`.

    Each writing has a folder of its own with a rising number, which counts from when its mark of success is there.
    The table before, with its layers, stays for whoever is reading it; older writings, and unfinished ones, go.
    """
    before = _writings(df.sparkSession, path)
    _write(df, path, before)
    kept = _current(before)
    _delete(df.sparkSession, [w for w in before if w not in kept])


def amend(new: DataFrame, path: str, key: str, order: str | None = None) -> None:
    """Put `new` in the place of all rows of its keys; as whole or not at all as `replace`, and `new` may read from `path`.

    Only `new` is written, as a layer that `read` lays over the rest, so the work goes by the new rows and not by
    the table; the table is written whole once its layers weigh more than it, or are too many. Rows with a null key
    are added and replace nothing. The columns are the table's. With `order` files hold ranges of that column, in order,
    so that a filter on it skips most of them.
    """
    spark = new.sparkSession
    before = _writings(spark, path)
    parts = _current(before)
    placed = lambda df: df if order is None else df.repartitionByRange(order, key).sortWithinPartitions(order)
    if not parts:
        return replace(placed(new), path)
    table = read(spark, path)
    if set(new.columns) != set(table.columns):
        raise ValueError(f"columns differ: {sorted(set(new.columns) ^ set(table.columns))}")
    new = new.select(*[F.col(f.name).cast(f.dataType) for f in table.schema])
    layers = parts[1:]
    if len(layers) >= MOST_LAYERS or any(w.key != key for w in layers) or _bytes(spark, layers) > _bytes(spark, parts[:1]):
        return replace(placed(upserted(table, new, key)), path)
    at = _write(placed(new), path, before, key)
    if spark.read.parquet(at).isEmpty():
        fs, none = _fs(spark, at)
        fs.delete(none, True)
    first = _whole(before)[-2:][0].number
    _delete(spark, [w for w in before if not w.done or w.number < first])


def snapshot(tables: dict[str, DataFrame], root: str, keep: int, name: str | None = None) -> str:
    """Copies of the tables and a manifest of their rows under root/name; all but the newest `keep` snapshots go."""
    spark = next(iter(tables.values())).sparkSession
    name = name or datetime.now(UTC).strftime("snap-%Y%m%dT%H%M%SZ")
    fs, partial = _fs(spark, f"{root}/{name}.partial")
    fs.delete(partial, True)
    for table, df in tables.items():
        df.write.parquet(f"{partial}/{table}")
    counts = row_counts({t: spark.read.parquet(f"{partial}/{t}") for t in tables})
    manifest = {"name": name, "rows": {r.table_name: r.n for r in counts.collect()}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{partial}/manifest")
    _, done = _fs(spark, f"{root}/{name}")
    fs.rename(partial, done)
    _, top = _fs(spark, root)
    names = sorted((s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory() and not s.getPath().getName().endswith(".partial")), reverse=True)
    for old in names[keep:]:
        fs.delete(_fs(spark, f"{root}/{old}")[1], True)
    return f"{root}/{name}"
