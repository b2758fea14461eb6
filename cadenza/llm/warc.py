"""WARC archives: a deterministic sharded writer with revisit records, and a reader.

Records are range-sorted by page id. Each task writes one range: archives are
rolled when their compressed size reaches a limit, headers and digests are made
anew from the payloads, every archive is written under a temporary name and
renamed, and a manifest, written last, lists what belongs to the collection.
The same pages always give the same bytes, so a task may run again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import data_bytes, partitions_for, strings, tidied, utf8
from cadenza.llm.token_files import NO_ID, _read, _store, _write

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Ranges that a writer deals pages to at most; their edges are part of the plan.
MOST_RANGES = 20_000
READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest, head = base32_sha1(payload), HTTP_HEAD % len(payload)
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page-ID": "" if refers_to is None else str(refers_to)}
    fields["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """One gzip member with an empty timestamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(
    pages: DataFrame, out_dir: str, min_bytes: int = 0, roll_bytes: int = 256_000_000, level: int = 4, range_bytes: float = 64e6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> dict:
    """Write a record for every row to gzipped archives of ``out_dir``; returns the manifest.

    The payload is the html in UTF-8, null as empty. Of rows with equal
    payloads of at least ``min_bytes`` bytes, the one with the smallest page id
    is a response and the others are revisits of it; a repeated row with that
    id is a revisit too. Null urls count as empty, a null id is smaller than
    any other, white space in an url becomes single spaces, an empty table gives
    a manifest without archives, and other columns are not read. Html is shuffled once, into ranges of the page id;
    digests alone are grouped. An archive is rolled at ``roll_bytes``.
    """
    spark = pages.sparkSession
    rows = pages.select(F.coalesce(pages[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    light = rows.select("id", F.unhex(F.sha2("html", 256)).alias("digest"), F.octet_length("html").alias("n"))
    firsts = light.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    verdicts = light.where(F.col("n") >= min_bytes).select("id", "digest").distinct().join(firsts, "digest").select("id", "digest", "first")
    # Ranges grow beyond MOST_RANGES of them; a task streams its range and rolls archives by size, whatever the range's.
    n = min(MOST_RANGES, partitions_for(spark, data_bytes(pages, html_col), range_bytes))
    cuts = sorted(set(rows.select(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0] or []))
    _store(out_dir)[0].create_dir(_store(out_dir)[1], recursive=True)
    edges = F.lit(cuts).cast("array<bigint>") if cuts else None

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, shard, part, records, done = None, 0, None, 0, 0, []
        page, known, seen = None, {}, set()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                store.move(temporary, f"{folder}/{final}")
                done.append((final, records, at))
                out = None

        for batch in batches:
            urls, htmls = strings(utf8(batch.column(2))), strings(utf8(batch.column(3)))
            for k, (own, digest, first) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if own != page:
                    page, known, seen = own, {}, set()
                if digest is not None:
                    known[digest] = first
                    continue
                payload = htmls[k].encode()
                digest = hashlib.sha256(payload).digest() if known else None
                first = known.get(digest)
                revisit = first is not None and (first != own or digest in seen)
                seen.add(digest)
                if out is None:
                    shard = batch.column(0)[0].as_py()
                    store, folder = _store(out_dir)
                    final, temporary = f"part-{shard:06d}-{part:04d}.warc.gz", f"{folder}/.part-{shard:06d}-{part:04d}-{TaskContext.get().taskAttemptId()}"
                    out, at, records, part = store.open_output_stream(temporary, compression=None), 0, 0, part + 1
                    info = f"software: cadenza\r\nformat: WARC File Format 1.1\r\nisPartOf: {final}\r\n".encode()
                    member = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(shard, final)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {final}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", level)
                    out.write(member)
                    at += len(member)
                member = _member(_record(None if own == NO_ID else own, urls[k], payload, None if first in (None, NO_ID) else first, revisit), level)
                out.write(member)
                at += len(member)
                records += 1
                if at >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    none = F.lit(None)
    both = rows.select("id", "url", "html", none.cast("binary").alias("digest"), none.cast("bigint").alias("first")).unionAll(
        verdicts.select("id", none.cast("string").alias("url"), none.cast("string").alias("html"), "digest", "first")
    )
    # A page's verdicts come just before its rows; the range of an id is the number of edges below it, found bit by bit.
    shard, own = F.lit(0), F.col("id")
    if cuts:
        steps = F.lit([1 << b for b in reversed(range(len(cuts).bit_length()))])
        shard = F.aggregate(steps, F.lit(0), lambda below, step: F.when((below + step <= len(cuts)) & (F.get(edges, below + step - 1) < own), below + step).otherwise(below))
    written = (
        both.select(shard.cast("int").alias("shard"), "*")
        .repartitionById(len(cuts) + 1, F.col("shard"))
        .sortWithinPartitions("id", F.col("digest").isNull(), "digest", "html", "url")
        .mapInArrow(tidied(archives), "file string, records bigint, bytes bigint")
        .collect()
    )
    manifest = {"archives": sorted((r.asDict() for r in written), key=lambda x: x["file"])}
    _write(f"{out_dir}/manifest.json", json.dumps(manifest).encode())
    return manifest


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, read in pieces."""
    z, data = zlib.decompressobj(31), b""
    parts: list[bytes] = []
    while True:
        if not data:
            data = stream.read(1 << 16)
            if not data:
                break
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            record, parts, z = b"".join(parts), [], zlib.decompressobj(31)
            head, _, rest = record.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            block = rest[: int(fields["Content-Length"])]
            if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
                raise ValueError("a damaged record")
            yield fields, block
    if parts and any(parts):
        raise ValueError("a truncated archive")


def read_warc(spark: SparkSession, out_dir: str, with_payload: bool = False) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record in the manifest.

    With ``with_payload`` also ``url`` and ``payload`` (null for revisits).
    Raises ValueError where a block or payload doesn't have the digest its
    header says.
    """
    manifest = json.loads(_read(f"{out_dir}/manifest.json"))
    schema = READ_SCHEMA + (", url string, payload binary" if with_payload else "")
    if not manifest["archives"]:
        return spark.createDataFrame([], schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 7 if with_payload else 5]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, folder = _store(out_dir)
                rows = []
                with store.open_input_stream(f"{folder}/{file}", compression=None) as f:
                    for fields, block in records_of(f):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        payload, digest, number = block.partition(b"\r\n\r\n")[2], fields["WARC-Payload-Digest"].removeprefix("sha1:"), lambda x: int(x) if x else None
                        response = fields["WARC-Type"] == "response"
                        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or response and (base32_sha1(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"{file}: a digest differs")
                        row = (number(fields["X-Page-ID"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID", "")))
                        rows.append(row + ((fields["WARC-Target-URI"], payload if response else None) if with_payload else ()))
                        if len(rows) >= (100 if with_payload else 5000):
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    files = [(x["file"],) for x in manifest["archives"]]
    return spark.createDataFrame(files, "file string").repartition(len(files)).mapInArrow(tidied(rows_of), schema)
