"""Folders for tables that only a run needs, where driver and executors both reach them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, removed at its end. A local master without that setting gets a temporary one; a cluster an error."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="folioflow-")
            spark.sparkContext.setCheckpointDir(named)
        own = _own[app] = f"{named.rstrip('/')}/folioflow-{uuid.uuid4().hex}"

        def clear() -> None:
            try:
                if spark.sparkContext._jsc is not None:
                    remove(spark, own)
            except Exception:  # the session has gone; whoever owns the shared folder clears it
                return

        atexit.register(clear)
    return _own[app]


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the folder: computed once, free of its lineage."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
