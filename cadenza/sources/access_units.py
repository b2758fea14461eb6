"""A batch data source for streams of self-delimiting units.

A unit's first big-endian 16-bit word holds, in its low 12 bits, the unit's
length in words of 16 bits. Unit lengths chain, so a file is read by one task;
files are read in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "stream_id string, au bigint, byte_offset bigint, n_bytes int, payload binary, status string"


def frame_stream(f: BinaryIO, stream_id: str, start: int = 0, au: int = 0) -> Iterator[tuple]:
    """Units of a file from byte ``start`` on, one in memory at a time; rows as of frame().

    ``start`` and ``au`` come from a unit of an earlier read, so a reader can begin again there.
    """
    at = start
    f.seek(start)
    while True:
        head = f.read(2)
        if not head:
            return
        n = 2 * (int.from_bytes(head, "big") & 0xFFF) if len(head) == 2 else 0
        data = head + (f.read(n - 2) if n >= 4 else b"")
        if n < 4 or len(data) < n:
            yield stream_id, au, at, len(data), data, "truncated" if n >= 4 or len(head) < 2 else "corrupt"
            return
        yield stream_id, au, at, n, data, "ok"
        at, au = at + n, au + 1


def frame(data: bytes, stream_id: str) -> Iterator[tuple]:
    """Units of a stream; what can't be framed is one last row with a status other than ok: the bytes of a truncated unit, the length of a corrupt one."""
    at, au = 0, 0
    while at < len(data):
        n = 2 * (int.from_bytes(data[at : at + 2], "big") & 0xFFF) if at + 2 <= len(data) else 0
        if n < 4 or at + n > len(data):
            rest, whole = data[at:], n >= 4 or at + 2 > len(data)
            yield stream_id, au, at, len(rest if whole else rest[:2]), rest if whole else rest[:2], "truncated" if whole else "corrupt"
            return
        yield stream_id, au, at, n, data[at : at + n], "ok"
        at, au = at + n, au + 1


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, au: int = 0):
        self.path, self.start, self.au = path, start, au


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], start: int, au: int):
        self.paths, self.start, self.au = paths, start, au

    def partitions(self) -> list[InputPartition]:
        return [_File(p, self.start, self.au) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(path) as f:
            yield from frame_stream(f, partition.path, partition.start, partition.au)


class AccessUnits(DataSource):
    """``spark.read.format("access_units").option("paths", "uri,uri")``; ``start`` and ``au`` begin at a known unit of one file."""

    @classmethod
    def name(cls) -> str:
        return "access_units"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", "").split(",") if p], int(self.options.get("start", "0")), int(self.options.get("au", "0")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AccessUnits)
