"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

A shard holds, in ascending document order::

    MAGIC, sha256 of the dictionary (32 bytes)
    one zstandard frame for each document: its ids as little-endian integers
    index: a zstandard frame of the columns doc_id, offset, length, n_tokens (int64 each)
    TAIL: offset and length of the index, number of documents, bytes an id (uint64 each), MAGIC

Beside the shards lie ``dictionary`` and ``manifest.json``; the manifest, written
last, names the dictionary's hash and, for each shard, its first document and
the ids before it, so one document is found by two binary searches and one
short read. Shards are written under temporary names and then renamed, so a
task that runs twice leaves the same file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.chunks import drop_tables, encoded, word_chunks, word_table
from cadenza.llm.common import data_bytes, give_back, partitions_for, tidied

MAGIC = b"CTOKENS1"
TAIL = "<QQQQ8s"
TAIL_BYTES = struct.calcsize(TAIL)
NO_ID = -(2**63)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _write(uri: str, data: bytes) -> None:
    store, path = _store(uri)
    temporary = f"{path}.tmp-{os.getpid()}"
    with store.open_output_stream(temporary) as f:
        f.write(data)
    store.move(temporary, path)


def _read(uri: str) -> bytes:
    store, path = _store(uri)
    with store.open_input_stream(path) as f:
        return f.read()


@functools.cache
def _codecs(dictionary: bytes, level: int):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def _dtype(bytes_an_id: int) -> np.dtype:
    return np.dtype(f"<u{bytes_an_id}")


def _packed(ids: np.ndarray, bytes_an_id: int) -> bytes:
    """Ids as little-endian integers; raises ValueError where one needs more bytes."""
    if len(ids) and int(ids.max()) >> (8 * bytes_an_id):
        raise ValueError(f"an id needs more than {bytes_an_id} bytes")
    return ids.astype(_dtype(bytes_an_id)).tobytes()


def train_dictionary(rows: DataFrame, tokenizer_path: str, end_id: int, bytes_an_id: int, n_samples: int, size: int, sample_bytes: int = 8192) -> bytes:
    """A dictionary from the ids of ``n_samples`` documents at most, those with the smallest id hashes.

    Of each, the first ``sample_bytes`` bytes of ids are taken (4,096 ids of
    two bytes by default). Both bounds are needed as training runs on the
    driver. The dictionary changes the size of the files only, never what is
    read back. Empty if the samples are too few to train from.
    """
    chosen = [r[0] for r in rows.select("id").orderBy(F.xxhash64("id"), "id").limit(n_samples).collect()]
    if not chosen:
        return b""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer_path)
        for batch in batches:
            for _, ids, bounds in encoded(batch.column(0), table, word_chunks):
                found = [_packed(np.append(ids[a:b], end_id), bytes_an_id)[:sample_bytes] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    samples = sorted(bytes(r[0]) for r in rows.where(F.col("id").isin(chosen)).select("text").mapInArrow(tidied(ids_of), "ids binary").limit(2 * n_samples).collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_token_files(
    documents: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3, bytes_an_id: int = 2, shard_bytes: float = 64e6, n_samples: int = 500, dictionary_bytes: int = 65536, sample_bytes: int = 8192
) -> dict:
    """Write every document's ids, with ``end_id`` after them, to shards of ``out_dir``; returns the manifest.

    Null texts count as empty (the end id alone), a null id comes first and is
    read back as null, documents of one id stay side by side, an empty table
    gives a manifest without shards; other columns are not read; an id that
    doesn't fit in ``bytes_an_id`` raises. Texts are
    encoded before the only shuffle, so that compressed frames travel. Shards
    are ranges of the id; ``n_samples`` and ``sample_bytes`` bound what the
    dictionary is trained on (see train_dictionary()); a shard's index (32 bytes a document) is all that a
    task holds.
    """
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(documents[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"), documents[text_col].alias("text"))
    n = partitions_for(spark, data_bytes(documents, text_col), shard_bytes)
    cuts = rows.select(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    dictionary = train_dictionary(rows, tokenizer_path, end_id, bytes_an_id, n_samples, dictionary_bytes, sample_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    _store(out_dir)[0].create_dir(_store(out_dir)[1], recursive=True)
    _write(f"{out_dir}/dictionary", dictionary)
    edges = np.array(sorted(set(cuts)), np.int64)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (compressor, _) = word_table(tokenizer_path), _codecs(dictionary, level)
        for batch in batches:
            names = batch.column(0).to_numpy()
            shards = np.searchsorted(edges, names, "left").astype(np.int32)
            for a, ids, bounds in encoded(batch.column(1), table, word_chunks):
                k = len(bounds) - 1
                packed = [compressor.compress(_packed(np.append(ids[i:j], end_id), bytes_an_id)) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[a : a + k]), pa.array(names[a : a + k]), pa.array(np.diff(bounds) + 1), pa.array(packed, pa.binary())], names=["shard", "id", "n_tokens", "frame"]
                )

    def shard_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers come from the stage before, with its tables.
        drop_tables()
        give_back()
        out, index, at, shard, store, temporary = None, [], 0, -1, None, ""
        for batch in batches:
            if out is None and batch.num_rows:
                shard = batch.column(0)[0].as_py()
                store, folder = _store(out_dir)
                temporary = f"{folder}/.shard-{shard:06d}-{TaskContext.get().taskAttemptId()}"
                out = store.open_output_stream(temporary)
                out.write(MAGIC + bytes.fromhex(digest))
                at = len(MAGIC) + 32
            for name, n_tokens, frame in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out.write(frame)
                index.append((name, at, len(frame), n_tokens))
                at += len(frame)
        if out is not None:
            table = np.array(index, "<i8")
            packed = zstandard.ZstdCompressor(level=level).compress(table.T.tobytes())
            out.write(packed + struct.pack(TAIL, at, len(packed), len(index), bytes_an_id, MAGIC))
            out.close()
            final = f"shard-{shard:06d}.tok"
            store.move(temporary, f"{folder}/{final}")
            yield pa.RecordBatch.from_pydict({"file": [final], "first": [index[0][0]], "docs": [len(index)], "tokens": [int(table[:, 3].sum())], "bytes": [at + len(packed) + TAIL_BYTES]})

    written = (
        rows.mapInArrow(tidied(frames), "shard int, id bigint, n_tokens bigint, frame binary")
        .repartitionById(len(edges) + 1, F.col("shard"))
        .sortWithinPartitions("id", "n_tokens", "frame")
        .mapInArrow(tidied(shard_files), "file string, first bigint, docs bigint, tokens bigint, bytes bigint")
        .collect()
    )
    shards, start = [], 0
    for r in sorted(written, key=lambda r: r.file):
        shards.append(r.asDict() | {"start": start})
        start += r.tokens
    manifest = {"dictionary_sha256": digest, "tokens": start, "shards": shards}
    _write(f"{out_dir}/manifest.json", json.dumps(manifest).encode())
    return manifest


def _index(f, size: int) -> tuple[np.ndarray, int]:
    f.seek(size - TAIL_BYTES)
    at, length, _, bytes_an_id, magic = struct.unpack(TAIL, f.read(TAIL_BYTES))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    f.seek(at)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read(length)), "<i8").reshape(4, -1), bytes_an_id


def _dictionary(out_dir: str, digest: str) -> bytes:
    dictionary = _read(f"{out_dir}/dictionary")
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary is not the one the shards were written with")
    return dictionary


def read_token_files(spark: SparkSession, out_dir: str, checksums: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files.

    ``start`` counts the ids of all documents before it; ``ids`` are
    little-endian unsigned 32-bit integers. With ``checksums``, their unsigned
    crc32 ``ids_crc32`` stands instead of ``ids``.
    """
    manifest = json.loads(_read(f"{out_dir}/manifest.json"))
    digest, last = manifest["dictionary_sha256"], ("ids_crc32", "bigint", pa.int64()) if checksums else ("ids", "binary", pa.binary())
    schema = f"doc_id bigint, start bigint, n_tokens bigint, {last[0]} {last[1]}"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        give_back()
        _, decompressor = _codecs(_dictionary(out_dir, digest), 3)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, folder = _store(out_dir)
                path = f"{folder}/{file}"
                with store.open_input_file(path) as f:
                    (names, offsets, lengths, n_tokens), bytes_an_id = _index(f, store.get_file_info(path).size)
                    starts, dtype = start + np.cumsum(n_tokens) - n_tokens, _dtype(bytes_an_id)
                    f.seek(len(MAGIC))
                    if f.read(32).hex() != digest:
                        raise ValueError(f"{file}: another dictionary")
                    for a in range(0, len(names), 1000):
                        b = min(a + 1000, len(names))
                        block = memoryview(f.read(int(offsets[b - 1] + lengths[b - 1] - offsets[a])))
                        found = []
                        for at, n in zip((offsets[a:b] - offsets[a]).tolist(), lengths[a:b].tolist(), strict=True):
                            ids = np.frombuffer(decompressor.decompress(block[at : at + n]), dtype).astype("<u4").tobytes()
                            found.append(zlib.crc32(ids) if checksums else ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[a:b], mask=names[a:b] == NO_ID), pa.array(starts[a:b]), pa.array(n_tokens[a:b]), pa.array(found, last[2])], names=["doc_id", "start", "n_tokens", last[0]]
                        )

    shards = [(x["file"], x["start"]) for x in manifest["shards"]]
    return spark.createDataFrame(shards, "file string, start bigint").repartition(len(shards)).mapInArrow(tidied(documents), schema)


def get_document(out_dir: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, without reading other documents; None if it isn't there."""
    manifest = json.loads(_read(f"{out_dir}/manifest.json"))
    firsts = [x["first"] for x in manifest["shards"]]
    k = int(np.searchsorted(firsts, doc_id, "right")) - 1
    if k < 0:
        return None
    store, folder = _store(out_dir)
    path = f"{folder}/{manifest['shards'][k]['file']}"
    with store.open_input_file(path) as f:
        (names, offsets, lengths, _), bytes_an_id = _index(f, store.get_file_info(path).size)
        i = int(np.searchsorted(names, doc_id))
        if i == len(names) or names[i] != doc_id:
            return None
        f.seek(int(offsets[i]))
        frame = f.read(int(lengths[i]))
    _, decompressor = _codecs(_dictionary(out_dir, manifest["dictionary_sha256"]), 3)
    return np.frombuffer(decompressor.decompress(frame), _dtype(bytes_an_id)).astype(np.int64)
