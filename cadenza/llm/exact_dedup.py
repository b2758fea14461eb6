"""Exact deduplication by a stateful stream, in DataFrame operations alone.

Digests of the texts stream through a keyed aggregation whose state lives on
disk (RocksDB) and never expires: for each digest the number of rows, and the
stable identifier and content locator of the row that stays. The state is then
read as a table. Rows whose digest has been met more than once are hits; their
full text is compared with the text at the locator, and a digest that two texts
share is settled by the texts themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import at_locator, data_bytes, drop_path, shared_dir, shuffles_dropped, staged, text_column

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_digests(spark: SparkSession, digests: str, checkpoint: str, partitions: int, max_files: int = 1000) -> DataFrame:
    """Feed the digest files that the stream has not met to its state, and return the state as a table.

    ``partitions``: of the state, about 16 MB of documents each (a store has
    fixed costs on its disk). ``digests``: a folder of Parquet files with ``digest, id, file, row``; more
    files may come later, and a later call takes up only those. Returns
    ``digest, n, keep`` with ``keep`` the struct ``(id, file, row)`` of the row
    with the largest id (then file, then row number).
    """
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        # Of a new stream only: a stream keeps the partitions that it began with.
        "spark.sql.streaming.internal.stateStore.partitions": str(partitions),
    }
    had = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema("digest binary, id bigint, file string, row bigint").option("maxFilesPerTrigger", max_files).parquet(digests)
        kept = source.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))
        query = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    n, keep = state.schema["value"].dataType.names[:2]
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{n}").alias("n"), F.col(f"value.{keep}").alias("keep"))


#: Rows of one digest whose texts one task compares, and the most partitions of a stream's state.
SALT_ROWS, STATE_PARTITIONS = 1000, 4096


def _digests(new: DataFrame, path: str) -> DataFrame:
    """Add the rows of files that ``path`` has no digests of, and return all."""
    spark = new.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        met = spark.read.schema(new.schema).parquet(path).select("file").distinct()
        new = new.join(met, "file", "left_anti").select("digest", "id", "file", "row")
    with shuffles_dropped(spark):
        new.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """Which rows have equal texts, and which of them stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``. Texts are equal when identical byte for byte; null counts as
    empty. Of equal texts the row with the largest id stays; of rows with the
    same id and text one stays (the last by file and row number), and a null id
    is smaller than any other. An empty table gives no rows; other columns,
    whatever their names, are not read. ``documents`` must be read from files,
    as a row's locator is its file and row number.

    With ``state_dir`` (a folder that all executors share) digests and the
    stream's state stay there without expiry. A later call with that folder and
    a table that has grown by files digests the new files only and goes on from
    the state; verdicts are those of all rows. Files must not change.
    """
    return _verdicts(documents, id_col, text_col, state_dir).drop("file", "row")


def _verdicts(documents: DataFrame, id_col: str, text_col: str, state_dir: str | None = None) -> DataFrame:
    """The rows of exact_dedup() with their locators ``file, row``."""
    spark = documents.sparkSession
    work = shared_dir(spark, "exact-dedup")
    held = state_dir or work
    rows = documents.select(
        documents[id_col].cast("bigint").alias("id"), text_column(documents, text_col).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    digested = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = _digests(digested.select("digest", "id", "file", "row"), f"{held}/digests")
    if digests.isEmpty():
        return digests.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"), "file", "row")
    partitions = min(STATE_PARTITIONS, max(12, math.ceil(data_bytes(documents, text_col) / 16e6)))
    state = staged(stream_digests(spark, f"{held}/digests", f"{held}/stream", partitions), f"{work}/state")
    if state_dir is None:
        drop_path(spark, f"{work}/stream")

    # Full bytes of the hits: the text at a digest's locator against each text with that digest, which meet in groups of about SALT_ROWS.
    salts = F.expr(f"cast(ceil(n / {SALT_ROWS}) as int)")
    hits = digested.join(state.where("n > 1"), "digest").select("digest", "text", F.expr("file = keep.file and row = keep.row").alias("stored"), salts.alias("salts"), F.xxhash64("file", "row").alias("place"))
    hits = staged(hits, f"{work}/hits")
    stored = hits.where("stored").select("digest", F.col("text").alias("stored_text"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    compared = hits.withColumn("salt", F.expr("cast(pmod(place, salts) as int)")).join(stored, ["digest", "salt"])
    shared = staged(compared.where("text != stored_text").select("digest").distinct(), f"{work}/shared")
    drop_path(spark, f"{work}/hits")

    columns = [F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), F.expr("file = keep.file and row = keep.row").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "file", "row"]
    if shared.isEmpty():
        return digests.join(state, "digest").select(*columns)
    # Two texts with one digest: group these rows by their texts.
    apart = digested.join(shared, "digest", "left_semi")
    groups = apart.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))
    return digests.join(shared, "digest", "left_anti").join(state, "digest").select(*columns).unionAll(apart.join(groups, ["digest", "text"]).select(*columns))


def keep_one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without those whose text another kept row has; all columns stay.

    Exactly one row of each text stays, whatever rows share its id: verdicts
    are joined back by file and row number.
    """
    kept = _verdicts(documents, id_col, text_col).where("kept").select("file", "row")
    return documents.join(kept, at_locator(documents, kept), "left_semi")
