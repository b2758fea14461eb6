"""Working folders, sizes and Arrow helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to numpy at once, in bytes; bounds a Python worker's memory.
SLICE_BYTES = 1_000_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which every executor can reach.

    Only in local mode, where a session may name none (tests), a temporary one
    is set; on a cluster that raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_by_call.get() if set_by_call.isDefined() else None
    if not base and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files are deleted as it ends: what it wrote is read from the shared folder from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def small_batches(spark: SparkSession, n_bytes: int = 4_000_000) -> SparkSession:
    """Bound the Arrow batches of a session that hasn't bound them itself: both sides of a Python worker hold whole ones.

    A session setting, as the operators' results are read after they return.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) >= 1 << 26:
        spark.conf.set(name, str(n_bytes))
    return spark


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back: cuts lineage and survives lost executors."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers outlive their tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, giving freed memory back when a task ends."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return tidy


class SliceTable:
    """A working table that tasks look up by the number of a slice, without a shuffle of what they look it up for.

    It lies in the shared folder, ``together`` neighbouring slices in one of
    ``files`` folders, in order, so that a look-up reads few row groups.
    """

    def __init__(self, path: str, files: int, together: int, schema: pa.Schema):
        self.path, self.files, self.together, self.schema = path, files, together, schema
        self._last: tuple | None = None
        self._opened: tuple | None = None

    def rows(self, number: int) -> pa.Table:
        """The rows of a slice; the last look-up is kept."""
        if self._last is None or self._last[0] != number:
            folder = number // self.together % self.files
            if self._opened is None or self._opened[0] != folder:
                store, path = fs.FileSystem.from_uri(f"{self.path}/folder={folder}")
                there = store.get_file_info(path).type == fs.FileType.Directory
                self._opened = folder, dataset.dataset(path, filesystem=store, format="parquet") if there else None
            held = self._opened[1]
            self._last = number, self.schema.empty_table() if held is None else held.to_table(columns=self.schema.names, filter=dataset.field("slice") == number, use_threads=False)
        return self._last[1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_last": None, "_opened": None}


def write_slices(df: DataFrame, path: str, files: int, together: int) -> SliceTable:
    """Write ``df``, which has a bigint ``slice``, for look-up by slice."""
    from pyspark.sql.pandas.types import to_arrow_schema

    folder = F.pmod(F.shiftright("slice", together.bit_length() - 1), F.lit(files)).cast("int")
    dealt = df.withColumn("folder", folder).repartition(files, "folder").sortWithinPartitions("folder", "slice")
    with shuffles_dropped(df.sparkSession):
        dealt.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 1 << 21).partitionBy("folder").parquet(path)
    return SliceTable(path, files, together, to_arrow_schema(df.schema))


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete working folders that no returned DataFrame reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def at_locator(documents: DataFrame, rows: DataFrame) -> Column:
    """The condition that joins ``rows`` (``file, row``) to a DataFrame read from files."""
    return (documents["_metadata.file_path"] == rows["file"]) & (documents["_metadata.row_index"] == rows["row"])


def data_bytes(df: DataFrame, text_col: str) -> float:
    """The size of a DataFrame's files by Catalyst's estimate; of its texts, measured, where there is none."""
    known = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 2**60 else float(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def partitions_for(spark: SparkSession, n_bytes: float, each: float = 32e6) -> int:
    """Partitions of about ``each`` bytes, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each))


def text_slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to about ``limit``; a longer row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def utf8(column: pa.Array) -> pa.Array:
    """A string column as large_string with nulls as empty text."""
    return column.cast(pa.large_string()).fill_null("")


def strings(column: pa.Array) -> list[str | None]:
    """A string column as a list; several times as fast as to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of every text of a large_string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array (no nulls), and where each text begins, with the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def spans_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(starts[i], starts[i] + lengths[i])``."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def text_column(df: DataFrame, name: str):
    """A text column with nulls as empty text."""
    return F.coalesce(F.col(name), F.lit(""))
