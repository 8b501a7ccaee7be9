"""What the operators share on the driver: schemas, hashed folds, tables cut loose from their lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow.session import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_schema(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(k)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def clear() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the session has gone; whoever owns the shared folder clears it
            return

    atexit.register(clear)


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder, removed at its end, in the one that driver and executors share. Where none is named a local one is made, as in tests; on a cluster that is an error."""
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="folioflow-")
            spark.sparkContext.setCheckpointDir(named)
        _own_folders[app] = f"{named.rstrip('/')}/folioflow-{uuid.uuid4().hex}"
        _remove_at_exit(spark, _own_folders[app])
    return _own_folders[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, read by any executor, free of its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `written` that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.written_at)


def own_name(df: DataFrame, base: str) -> str:
    """A column name like `base` that `df` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_udf(work, schema: StructType):
    """A column function text -> struct. work(bytes, offsets) gets whole texts, about a megabyte at a time, and returns the struct's columns.

    It is marked nondeterministic so that a filter on its result isn't pushed below it and run twice.
    """
    from collections.abc import Iterator

    from folioflow.llm.text import slices

    arrow = arrow_schema(schema)
    kind = pa.struct(list(arrow))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = []
            for _, buf, offsets in slices(pa.RecordBatch.from_arrays([column], ["text"])):
                columns = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(work(buf, offsets), arrow, strict=True)]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(arrow)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()
