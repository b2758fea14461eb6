"""Files as streams of byte fragments, for ``units.stream_units``.

``spark.readStream.format("byte_fragments")``. An offset is the number of
fragments of each file that have been given, so that a restarted query reads
the same bytes again. Fragments have one size; a growing file's incomplete last
one waits until it is whole, or until the file is said to be ``complete``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id string, fragment bigint, data binary, final boolean"
#: Bytes that one task reads.
TASK_BYTES = 64_000_000


class _Run(InputPartition):
    def __init__(self, path: str, first: int, end: int, last: int | None):
        self.path, self.first, self.end, self.last = path, first, end, last


class _Fragments(DataSourceStreamReader):
    def __init__(self, paths: list[str], size: int, complete: bool):
        self.paths, self.size, self.complete = paths, size, complete

    def initialOffset(self) -> dict:
        return {p: 0 for p in self.paths}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        out = {}
        for p in self.paths:
            store, path = fs.FileSystem.from_uri(p)
            n = store.get_file_info(path).size or 0
            out[p] = max(1, -(-n // self.size)) if self.complete else n // self.size
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        each = max(1, TASK_BYTES // self.size)
        return [_Run(p, a, min(a + each, end[p]), end[p] - 1 if self.complete else None) for p in end for a in range(start.get(p, 0), end[p], each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(path) as f:
            for k in range(partition.first, partition.end):
                f.seek(k * self.size)
                yield partition.path, k, f.read(self.size), k == partition.last


class ByteFragments(DataSource):
    """Options: ``paths`` (``uri,uri``), ``bytes`` of a fragment (65,536), ``complete`` (``true``: the files don't grow; an empty one gives one empty last fragment)."""

    @classmethod
    def name(cls) -> str:
        return "byte_fragments"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        size = int(self.options.get("bytes", "65536"))
        if size < 1:
            raise ValueError("a fragment has one byte at least")
        return _Fragments([p for p in self.options.get("paths", "").split(",") if p], size, self.options.get("complete", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteFragments)
