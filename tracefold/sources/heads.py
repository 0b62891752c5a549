"""Heads of files as a data source: files are listed once, and no more than the first bytes of each are ever read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, modified timestamp, bytes bigint, head binary"
#: Files that one task reads.
FILES = 64


class Files(InputPartition):
    def __init__(self, rows: list[tuple[str, datetime, int]]) -> None:
        self.rows = rows


class HeadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.limit, self.suffix = options["path"], int(options.get("limit", 256 * 1024)), options.get("suffix", "")

    def store(self):
        """(file system, path): whatever pyarrow opens; a plain path is a local one."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, path = self.store()
        found = store.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
        rows = sorted((f.path, f.mtime, f.size) for f in found if f.is_file and f.path.endswith(self.suffix))
        return [Files(rows[lo : lo + FILES]) for lo in range(0, len(rows), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self.store()
        for path, modified, size in partition.rows:
            try:
                with store.open_input_stream(path, buffer_size=0) as f:
                    head = f.read(self.limit)
            except FileNotFoundError:  # gone since it was listed
                continue
            yield path, modified, size, head


class Heads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options)


def read_heads(spark: SparkSession, path: str, limit: int, suffix: str = "") -> DataFrame:
    """(path, modified, bytes, head) of the files of a folder whose names end so; bytes is the whole size, head has at most limit."""
    spark.dataSource.register(Heads)
    return spark.read.format("file_heads").options(path=path, limit=str(limit), suffix=suffix).load()
