"""Data sources: heads of book files (for detection without reading whole files), and the entries of archives."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.runtime import arrow_map, ship
from quire.sources.archive import Archive

HEAD = 4096


def detect_file(path: str) -> str:
    """The format of a file from its first bytes; of an archive only the directory, and the entry that names its type, are read."""
    from quire.sources.reader import classify_archive, detect

    with open(path, "rb") as f:
        head = f.read(HEAD)
        return classify_archive(f) if head[:4] in (b"PK\x03\x04", b"PK\x05\x06") else detect(head, path)


class Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class HeadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.per = int(options.get("filesPerPartition", "256"))

    def partitions(self) -> list[Part]:
        found: list[str] = []
        for folder, dirs, files in os.walk(self.root, onerror=lambda _: None):
            found += [os.path.join(folder, f) for f in files]
            if not self.recursive:
                dirs.clear()
        found.sort()
        return [Part(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [Part([])]

    def read(self, part: Part) -> Iterator[tuple]:
        for path in part.paths:
            try:
                yield path, os.path.getsize(path), detect_file(path), None
            except Exception as e:
                yield path, None, None, str(e)


class BookHeads(DataSource):
    """``spark.read.format("book_heads").load(folder)``: path, size, format and error of every file, from 4 KiB or the archive's directory.

    The folder is listed once on the driver, so it must be mounted there; ``discover`` lists other storage.
    """

    @classmethod
    def name(cls) -> str:
        return "book_heads"

    def schema(self) -> str:
        return "path string, size bigint, format string, error string"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(BookHeads)


def archive_entries(files: DataFrame) -> DataFrame:
    """(path, pos, name, size, packed, error): the entries of each archive of ``files`` (path, content); a damaged one is a row with its error."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                rows += [(path, i, n, e.file_size, e.compress_size, None) for i, (n, e) in enumerate(Archive(data or b"").entries.items(), 1)]
            except ValueError as e:
                rows.append((path, None, None, None, None, str(e)))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["path", "pos", "name", "size", "packed", "error"])

    return arrow_map(files.select("path", "content"), kernel, "path string, pos int, name string, size bigint, packed bigint, error string")
