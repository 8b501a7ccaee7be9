"""Several tables under one log of commits.

A commit is one small file that names the parts of every table; it is put in place last, by a rename, so a
reader sees all tables of one commit or all of the one before, wherever a writer stops. A reader stays with
the commit that it began with.

A table's parts are the whole of it (`rows`), and layers over that: `over` has new rows in place of all rows of
its keys, `gone` has keys alone, `more` has rows that are added. All write in proportion to what changes; a read lays them over the rest, and a table
that carries too much of them is written whole again within the change that would add to it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sinks.scratch import filesystem

#: A table is written whole again where its layers would be more than this, or weigh more than the rest of it.
MOST_LAYERS = 32
#: Commits that readers may still be with; parts that none of them names go.
KEPT = 8
#: Milliseconds that an old commit, or a part of none, is left alone.
GRACE_MS = 24 * 3600 * 1000
LOG = "_commits"


class Conflict(RuntimeError):
    """Another writer has made the commit that a change was to be."""


class Part(NamedTuple):
    kind: str  # rows, over, gone, more
    at: str  # folder below the tables' own
    key: str | None = None
    order: str | None = None  # column by which files hold ranges

    @property
    def number(self) -> int:
        return int(self.at.rsplit("/", 1)[1].split("-")[1])


class Version(NamedTuple):
    number: int
    tables: dict[str, list[Part]]


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A new file, whole or not at all; an error where there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = filesystem(spark, path)
    fs.mkdirs(target.getParent())
    _, partial = filesystem(spark, f"{path}.{uuid.uuid4().hex}.partial")
    out = fs.create(partial, False)
    out.write(bytearray(text.encode()))
    out.close()
    none = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
    how = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    how[0] = none
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(partial), fs.makeQualified(target), how)
    except Exception as e:
        fs.delete(partial, False)
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(path) from e
        raise


def read_file(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Tables:
    """Tables of one folder. `pinned`: the number of a commit to stay with; else each call reads the newest."""

    def __init__(self, spark: SparkSession, path: str, pinned: int | None = None):
        self.spark, self.path, self.pinned = spark, path.rstrip("/"), pinned

    def numbers(self) -> list[int]:
        fs, log = filesystem(self.spark, f"{self.path}/{LOG}")
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _file(self, number: int) -> str:
        return f"{self.path}/{LOG}/{number:012d}.json"

    def version(self) -> Version:
        number = self.pinned if self.pinned is not None else (self.numbers() or [0])[-1]
        if not number:
            return Version(0, {})
        held = json.loads(read_file(self.spark, self._file(number)))
        return Version(number, {t: [Part(*p) for p in parts] for t, parts in held["tables"].items()})

    def here(self) -> Tables:
        """These tables as they are now, whatever is committed later."""
        return Tables(self.spark, self.path, self.version().number)

    def read(self, name: str) -> DataFrame | None:
        return self._rows(self.version().tables.get(name))

    def _rows(self, parts: list[Part] | None) -> DataFrame | None:
        """Of each key the rows of the newest layer that has it, none if that is a deletion, else those of the whole table."""
        if not parts:
            return None
        at = lambda p, sub: f"{self.path}/{p.at}/{sub}"
        number = F.regexp_extract("_metadata.file_path", r"/(?:rows|over|gone|more)-(\d+)-[^/]*/[^/]*/[^/]*$", 1).cast("long")
        rows = self.spark.read.parquet(*[at(p, "rows") for p in parts if p.kind != "gone"])
        layers = parts[1:]
        if not layers:
            return rows
        out = rows.select("*", number.alias("__number"))
        for key in dict.fromkeys(p.key for p in layers if p.key):
            keys = self.spark.read.parquet(*[at(p, "keys") for p in layers if p.key == key])
            newest = keys.select(key, number.alias("__layer")).groupBy(key).agg(F.max("__layer").alias("__newest"))
            out = out.join(newest, key, "left").filter(F.col("__newest").isNull() | (F.col("__newest") <= F.col("__number"))).drop("__newest")
        return out.select(*rows.columns)

    def change(self) -> Change:
        return Change(self)

    def bytes_of(self, parts: list[Part]) -> int:
        total = 0
        for p in parts:
            fs, at = filesystem(self.spark, f"{self.path}/{p.at}")
            total += fs.getContentSummary(at).getLength()
        return total

    def vacuum(self, kept: int = KEPT, grace_ms: int = GRACE_MS) -> int:
        """Remove commits but the newest `kept`, and parts that no commit left names; how many parts went. Neither goes before its grace: a reader may be with it, a writer at work."""
        now, gone = self.spark.sparkContext._jvm.System.currentTimeMillis(), 0
        numbers, left = self.numbers(), []
        for n in numbers:
            fs, file = filesystem(self.spark, self._file(n))
            if n in numbers[-kept:] or now - fs.getFileStatus(file).getModificationTime() < grace_ms:
                left.append(n)
            else:
                fs.delete(file, False)
        named = {p.at for n in left for parts in Tables(self.spark, self.path, n).version().tables.values() for p in parts}
        fs, top = filesystem(self.spark, self.path)
        for table in fs.listStatus(top) if fs.exists(top) else []:
            name = table.getPath().getName()
            if not table.isDirectory() or name.startswith("_"):
                continue
            for s in fs.listStatus(table.getPath()):
                if f"{name}/{s.getPath().getName()}" not in named and now - s.getModificationTime() >= grace_ms:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone


class Change:
    """What is to be one commit. It reads the tables as they were at its beginning, with what it has put so far.

    As a context: committed at its end; where an error ends it nothing has happened, and what it wrote is removed.
    """

    def __init__(self, tables: Tables):
        self.tables, self.base = tables, tables.version()
        self.parts = {t: list(p) for t, p in self.base.tables.items()}
        self.own: list[str] = []

    def read(self, name: str) -> DataFrame | None:
        return self.tables._rows(self.parts.get(name))

    def _new(self, name: str, kind: str) -> str:
        number = max((p.number for p in self.parts.get(name, [])), default=-1) + 1
        at = f"{name}/{kind}-{number:012d}-{uuid.uuid4().hex[:8]}"
        self.own.append(at)
        return at

    def _write(self, df: DataFrame, at: str, sub: str, order: str | None = None, key: str | None = None) -> None:
        if order is not None:
            df = df.repartitionByRange(*dict.fromkeys(c for c in (order, key) if c)).sortWithinPartitions(order)
        df.write.parquet(f"{self.tables.path}/{at}/{sub}")

    def replace(self, name: str, df: DataFrame, order: str | None = None) -> None:
        """All rows of a table anew; `df` may read from it."""
        at = self._new(name, "rows")
        self._write(df, at, "rows", order)
        self.parts[name] = [Part("rows", at, None, order)]

    def put(self, name: str, new: DataFrame, key: str = "paper_id", order: str | None = None, keys: DataFrame | None = None) -> None:
        """`new` in the place of all rows of its keys, and of those of `keys`, which may have no rows in `new`. Rows with a null key are added and replace nothing.

        The columns are the table's. With `order` files hold ranges of that column, so that a filter on it skips most of them.
        """
        have = self.parts.get(name)
        if not have:
            return self.replace(name, new, order)
        table = self.tables._rows(have[:1])
        if set(new.columns) != set(table.columns):
            raise ValueError(f"columns differ: {sorted(set(new.columns) ^ set(table.columns))}")
        at = self._new(name, "over")
        self._write(new.select(*[F.col(f.name).cast(f.dataType) for f in table.schema]), at, "rows", have[0].order, key)
        written = self.tables.spark.read.schema(table.schema).parquet(f"{self.tables.path}/{at}/rows")
        touched = written.select(key)
        if keys is not None:
            touched = touched.unionByName(keys.select(F.col(key).cast(table.schema[key].dataType).alias(key)))
        self._write(touched.filter(F.col(key).isNotNull()).distinct(), at, "keys")
        if not (written.isEmpty() and self._keys(at, key).isEmpty()):
            self._lay(name, Part("over", at, key))

    def append(self, name: str, new: DataFrame, order: str | None = None) -> None:
        """`new` besides the rows that are there; its columns are the table's."""
        have = self.parts.get(name)
        if not have:
            return self.replace(name, new, order)
        table = self.tables._rows(have[:1])
        if set(new.columns) != set(table.columns):
            raise ValueError(f"columns differ: {sorted(set(new.columns) ^ set(table.columns))}")
        at = self._new(name, "more")
        self._write(new.select(*[F.col(f.name).cast(f.dataType) for f in table.schema]), at, "rows", have[0].order)
        self._lay(name, Part("more", at))

    def delete(self, name: str, keys: DataFrame, key: str = "paper_id") -> None:
        """No row of these keys any more; only the keys are written. A table that isn't there has none."""
        have = self.parts.get(name)
        if not have:
            return
        at = self._new(name, "gone")
        kind = self.tables._rows(have[:1]).schema[key].dataType
        self._write(keys.select(F.col(key).cast(kind).alias(key)).filter(F.col(key).isNotNull()).distinct(), at, "keys")
        if not self._keys(at, key).isEmpty():
            self._lay(name, Part("gone", at, key))

    def _keys(self, at: str, key: str) -> DataFrame:
        return self.tables.spark.read.parquet(f"{self.tables.path}/{at}/keys").select(key)

    def _lay(self, name: str, part: Part) -> None:
        parts = [*self.parts[name], part]
        self.parts[name] = parts
        layers = parts[1:]
        if len(layers) > MOST_LAYERS or self.tables.bytes_of(layers) > self.tables.bytes_of(parts[:1]):
            self.replace(name, self.read(name), parts[0].order)

    def commit(self) -> int:
        """The commit's number; nothing is written where nothing was changed. Conflict where another commit came between."""
        if self.parts == self.base.tables:
            return self.base.number
        number = self.base.number + 1
        held = {"tables": {t: [list(p) for p in parts] for t, parts in sorted(self.parts.items())}}
        write_file(self.tables.spark, self.tables._file(number), json.dumps(held))
        self.own = []
        return number

    def drop(self) -> None:
        """Remove what a change wrote that is not to be."""
        for at in self.own:
            fs, p = filesystem(self.tables.spark, f"{self.tables.path}/{at}")
            fs.delete(p, True)
        self.own = []

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            try:
                self.commit()
            except Conflict:
                self.drop()
                raise
        else:
            self.drop()


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, a sum over all rows that no order changes): equal of equal tables, copies counted."""
    columns = sorted(df.columns)
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(one), F.lit(0)).cast("decimal(38,0)").alias("s")).first()
    return r.n, int(r.s)


class Differs(RuntimeError):
    """A shadow copy that doesn't hold what it was copied from."""


def rebuild(tables: Tables, name: str) -> tuple[int, int]:
    """A table written whole again without its layers: a shadow copy is read back and held against the table by rows and checksum, and takes its place only if they agree.

    Gives (rows, checksum). Readers see the one or the other; refused with Differs, nothing has changed.
    """
    with tables.change() as c:
        before = checksum(c.read(name))
        c.replace(name, c.read(name), c.parts[name][0].order)
        after = checksum(c.read(name))
        if before != after:
            raise Differs(f"{name}: {before} before, {after} after")
    return after


def row_total(tables: Tables) -> DataFrame:
    """table_name, n of one commit."""
    now = tables.here()
    parts = [now.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in sorted(now.version().tables)]
    return reduce(DataFrame.unionByName, parts)
