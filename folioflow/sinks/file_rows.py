"""A sink that writes one file a row, whole or not at all.

    spark.dataSource.register(FileRows)
    df.write.format("folioflow_files").mode("append").save(path)

Rows are (file, value), value text or bytes; a null value is an empty file. A file is written beside its place
under another name and then moved there, so no reader and no failed task meets half of one, and a task that is run again
writes the same files. `path` is anything that pyarrow's file systems open on every executor, a shared mount or a store.
Mode overwrite replaces files of the same name and leaves others; mode append too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Where files are while they are written, below the path.
PARTIAL = ".partial"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path if not path.startswith("file:") else "file://" + path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        import uuid

        fs, top = _filesystem(self.path)
        mine, n, seen = f"{top}/{PARTIAL}/{uuid.uuid4().hex}", 0, set()
        fs.create_dir(mine, recursive=True)
        try:
            for batch in iterator:
                for name, value in zip(batch["file"].to_pylist(), batch["value"].to_pylist(), strict=True):
                    parts = (name or "").split("/")
                    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts):
                        raise ValueError(f"not a file's name: {name!r}")
                    with fs.open_output_stream(f"{mine}/file") as f:
                        f.write(value.encode() if isinstance(value, str) else bytes(value or b""))
                    folder = "/".join([top, *parts[:-1]])
                    if folder not in seen:
                        fs.create_dir(folder, recursive=True)
                        seen.add(folder)
                    fs.move(f"{mine}/file", f"{folder}/{parts[-1]}")
                    n += 1
        finally:
            fs.delete_dir(mine)
        return Written(n)

    def _clear(self) -> None:
        from pyarrow import fs as arrow

        fs, top = _filesystem(self.path)
        if fs.get_file_info(f"{top}/{PARTIAL}").type != arrow.FileType.NotFound:
            fs.delete_dir(f"{top}/{PARTIAL}")

    def commit(self, messages: list) -> None:
        """What tasks that were stopped have left goes; the others' files are in their places."""
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


class FileRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folioflow_files"

    def schema(self) -> str:
        return "file string, value binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if sorted(f.name for f in schema) != ["file", "value"]:
            raise ValueError("rows are (file, value)")
        return FileWriter(self.options["path"])


def save(rows: DataFrame, path: str) -> None:
    """Rows (file, value) as files below `path`; of rows with one name the last written stays."""
    from folioflow.session import ship

    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(FileRows)
    rows.select("file", "value").write.format("folioflow_files").mode("append").save(path)
