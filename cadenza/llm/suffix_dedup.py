"""Repeated-substring removal by bucket-pointer refinement over anchored suffixes.

Every 50-byte string has an anchor: the place of its least 25-byte hash among
its 26. Equal strings have the same anchor, so the suffixes at anchors (one in
thirteen) stand for all. They are put in buckets by their first q = 25 bytes;
buckets of a single document are settled and leave. Suffixes of one bucket with
one 75-byte context (all 26 strings of the anchor) are folded, with the
smallest document as owner; a bucket with one context is settled by it.

The other buckets are refined on the contexts' bytes (``bucket_pointers``): all
places of the contexts start in buckets of their first 8 bytes, and buckets are
then sorted on the bucket pointers 8, 16 and 18 bytes later. The pointers that
a round updates are those which the next one reads, so depth goes 8, 16, 32,
50. Places with one pointer then begin equal 50-byte strings, byte by byte.

Contexts are folded by their bucket's and their own 64-bit hash; only within a
bucket can two contexts be taken for one, with a chance of 2**-64 a pair.
Texts are never shuffled: each pass reads them where they lie and looks up what
is known of its rows in a table written by slices of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SliceTable, byte_lengths, data_bytes, drop_path, partitions_for, shared_dir, spans_to_index, staged, text_bytes, text_slices, tidied, utf8, write_slices
from cadenza.llm.hashing import Bytes, mix
from cadenza.llm.token_files import NO_ID

#: Bytes of a repeated string, of a bucket's first refinement, and strings that share an anchor.
LENGTH, Q = 50, 25
STRINGS = LENGTH - Q + 1
ALL = (1 << STRINGS) - 1
#: Bytes of the first buckets of a refinement, and how far each round looks ahead: 8, 16, 32, 50 bytes deep.
GRAM, LOOKS = 8, (8, 16, 18)
#: Rows of a file that are handled together, and contexts of an anchor up to which one task compares them.
SLICE_ROWS, FEW = 2048, 4096
#: Slices whose rows of a working table lie together (a power of two).
TOGETHER = 32
#: Bytes of text whose anchors are found at once; a longer text is handled whole. Anchors that a slice sends on at once.
ANCHOR_BYTES, SENT = 1_000_000, 1_000_000


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over each ``width`` values of x from each place on; shorter by width - 1."""
    out, have = x, 1
    while 2 * have <= width:
        out, have = f(out[:-have], out[have:]), 2 * have
    return f(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[Bytes, np.ndarray, np.ndarray]:
    """``(hashes, places, identifiers)`` of the anchors of some texts' bytes; only whole strings inside a text have one."""
    held = Bytes(raw)
    if len(raw) < LENGTH:
        return held, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = held.windows(Q) | np.uint64(1)
    least = _sliding(grams, STRINGS, np.minimum)
    # No string begins in the last 49 bytes of a text.
    tails = np.minimum(np.diff(bounds), LENGTH - 1)
    at = spans_to_index(bounds[1:] - tails, tails)
    least[at[at < len(least)]] = 0
    least = np.pad(least, STRINGS - 1)
    places = np.flatnonzero(_sliding(least, STRINGS, np.maximum)[: len(grams)] == grams)
    return held, places, grams[places]


def _six(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; keys are minima, so their own high bits would crowd the first parts."""
    return (mix(keys) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _seen(low: np.ndarray, part: np.ndarray | np.uint64) -> np.ndarray:
    """One number for a part and the low 48 bits of a key. Two keys with one number merely go on together."""
    return mix((low & np.uint64((1 << 48) - 1)) + mix(np.atleast_1d(part).astype(np.uint64)))


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _bucket_blobs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each slice and part, the anchors' identifiers: of one document, and of several.

    A slice with many anchors sends several rows; a document's own identifiers in two of them are taken for shared, which only costs time.
    """

    def rows(slice_: int, met: list) -> pa.RecordBatch:
        keys, text = (np.concatenate(x) for x in zip(*met, strict=True))
        order = np.lexsort((text, keys))
        keys, text = keys[order], text[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        last = np.append(new[1:], len(keys)) - 1
        several, keys = text[new] != text[last], keys[new]
        part = _part(keys, parts)
        order = np.argsort(part, kind="stable")
        part, several, keys = part[order], several[order], keys[order]
        found = [(int(part[i]), slice_, _six(keys[i:j][~several[i:j]]), _six(keys[i:j][several[i:j]])) for i, j in _runs(part)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "slice", "one", "several"])

    for batch in batches:
        texts, own = utf8(batch.column(1)), batch.column(0).to_numpy()
        for a, b in _runs(own):
            part_of = texts.slice(a, b - a)
            met, many = [], 0
            for c, d in text_slices(byte_lengths(part_of), ANCHOR_BYTES):
                raw, bounds = text_bytes(part_of.slice(c, d - c))
                _, places, keys = anchors(raw, bounds)
                met.append((keys, (c + np.searchsorted(bounds, places, "right")).astype(np.uint32)))
                many += len(keys)
                if many >= SENT:
                    yield rows(int(own[a]), met)
                    met, many = [], 0
            if many:
                yield rows(int(own[a]), met)


def _shared_buckets(table: pa.Table) -> pa.Table:
    """Of one part, the identifiers that more than one document has, for each slice that has them."""
    slices, ones, severals = table["slice"].to_pylist(), table["one"].to_pylist(), table["several"].to_pylist()
    lists = [(_wide(a), _wide(b)) for a, b in zip(ones, severals, strict=True)]
    every = np.concatenate([x for pair in lists for x in pair] or [np.zeros(0, np.uint64)])
    keys, counts = np.unique(every, return_counts=True)
    shared = np.union1d(keys[counts > 1], np.concatenate([b for _, b in lists] or [np.zeros(0, np.uint64)]))
    del every, keys, counts
    at = lambda a: np.minimum(np.searchsorted(shared, a), max(len(shared) - 1, 0))
    found = [np.concatenate([a[shared[at(a)] == a] if len(shared) else a[:0], b]) for a, b in lists]
    keep = [k for k, x in enumerate(found) if len(x)]
    part = table["part"][0].as_py()
    return pa.table([pa.array([slices[k] for k in keep], pa.int64()), pa.array([part] * len(keep), pa.int32()), pa.array([_six(found[k]) for k in keep], pa.binary())], names=["slice", "part", "keys"])


def _contexts(batches: Iterator[pa.RecordBatch], shared: SliceTable, parts: int) -> Iterator[pa.RecordBatch]:
    """Of ``slice, row, id, text``: anchors in shared buckets, with their contexts."""
    for batch in batches:
        column, slices = utf8(batch.column(3)), batch.column(0).to_numpy()
        for i, j in _runs(slices):
            table = shared.rows(int(slices[i]))
            if not table.num_rows:
                continue
            known = np.sort(np.concatenate([_seen(_wide(x), np.uint64(p)) for p, x in zip(table["part"].to_pylist(), table["keys"].to_pylist(), strict=True)]))
            own = column.slice(i, j - i)
            for a, b in text_slices(byte_lengths(own), ANCHOR_BYTES):
                raw, bounds = text_bytes(own.slice(a, b - a))
                held, places, keys = anchors(raw, bounds)
                numbers = _seen(keys, _part(keys, parts))
                wanted = known[np.minimum(np.searchsorted(known, numbers), len(known) - 1)] == numbers
                places, keys = places[wanted], keys[wanted]
                text = np.searchsorted(bounds, places, "right") - 1
                starts, ends = np.maximum(places - (STRINGS - 1), bounds[text]), np.minimum(places + LENGTH, bounds[text + 1])
                before = places - starts
                # The context's identifier from those of the parts before, at and behind the anchor.
                context = mix(mix(held.hashes(starts, places) + before.astype(np.uint64)) + mix(keys + (ends - places).astype(np.uint64)) + held.hashes(places + Q, ends))
                at = pa.array(i + a + text)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in range(3)), pa.array(places - bounds[text]), pa.array(keys.view(np.int64)), pa.array(context.view(np.int64))], names=["slice", "row", "id", "place", "key", "context"]
                )


def _context_bytes(batches: Iterator[pa.RecordBatch], spots: SliceTable) -> Iterator[pa.RecordBatch]:
    """Of ``slice, row, text``: the bytes of the contexts around the places that ``spots`` names."""
    for batch in batches:
        slices, numbers, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for i, j in _runs(slices):
            table = spots.rows(int(slices[i]))
            rows = table["row"].to_numpy() if table.num_rows else np.zeros(0, np.int64)
            # A file's rows come in order, but a batch may hold a part of the slice only.
            at = np.searchsorted(numbers[i:j], rows)
            mine = np.flatnonzero((at < j - i) & (numbers[i:j][np.minimum(at, j - i - 1)] == rows))
            mine = mine[np.argsort(at[mine], kind="stable")]
            cut, before, last, data = [], [], -1, b""
            for k, p in zip(at[mine].tolist(), table["place"].to_numpy()[mine].tolist() if len(mine) else [], strict=True):
                if k != last:
                    data, last = texts[i + k].as_buffer().to_pybytes() if texts[i + k].is_valid else b"", k
                cut.append(data[max(0, p - STRINGS + 1) : p + LENGTH])
                before.append(min(p, STRINGS - 1))
            if cut:
                own = table.select(["key", "context", "owner", "contexts"]).take(pa.array(mine)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cut, pa.binary()), pa.array(before, pa.int32())], names=["key", "context", "owner", "contexts", "bytes", "before"])


def bucket_pointers(raw: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The bucket pointer of every place of some texts' bytes: equal for equal 50-byte strings with equal ``apart``, and for no others.

    ``apart`` must keep two places apart at which nothing is to be compared; it
    must step alike with the place. Places with fewer than 50 bytes left in
    their text hold pointers of their own. A pointer is its bucket's last slot
    in the order of suffixes, so a refined bucket's pointers stay within it.
    """
    n = len(raw)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    padded = np.concatenate([raw, np.zeros(GRAM, np.uint8)])
    first = np.zeros(n, np.uint64)
    for j in range(GRAM):
        first = (first << np.uint64(8)) | padded[j : j + n]
    pointer = np.arange(n)
    active, keys = np.flatnonzero(left >= GRAM), None
    # Slots are dealt from n on, so that they differ from the places without a bucket.
    base, depth = n, GRAM
    for look in (0, *LOOKS):
        if look:
            depth += look
            active = active[left[active] >= depth]
            order = np.lexsort((pointer[active + look], pointer[active]))
            active = active[order]
            keys = (pointer[active], pointer[active + look])
        else:
            order = np.lexsort((first[active], apart[active]))
            active = active[order]
            keys = (apart[active], first[active])
        if not len(active):
            break
        new = np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(active)))
        # The updated pointers are what the next round sorts on; all are new slots, as some places have left.
        pointer[active] = base + np.repeat(begins + sizes - 1, sizes)
        base += len(active)
    return pointer


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which strings of each context a smaller document has: rows of an anchor come together, FEW at most."""

    def masks(table: pa.Table) -> pa.RecordBatch:
        keys, owners, before = table["key"].to_numpy(), table["owner"].to_numpy(), table["before"].to_numpy()
        raw, bounds = text_bytes(table["bytes"].combine_chunks().cast(pa.large_binary()))
        sizes = np.diff(bounds)
        who = np.repeat(np.arange(len(keys)), sizes)
        offset = np.arange(len(raw)) - bounds[:-1][who] + (STRINGS - 1) - before[who]
        # Only places of one anchor at one distance from it can begin equal strings.
        anchor = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else keys
        pointer = bucket_pointers(raw, bounds, anchor[who] * (2 * LENGTH) + offset)
        whole = np.flatnonzero(np.repeat(bounds[1:], sizes) - np.arange(len(raw)) >= LENGTH)
        who, offset, pointer = who[whole], offset[whole], pointer[whole]
        order = np.lexsort((owners[who], pointer))
        first = np.concatenate([[True], pointer[order][1:] != pointer[order][:-1]]) if len(order) else np.zeros(0, bool)
        least = owners[who[order]][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else owners[:0]
        gone = least < owners[who[order]]
        mask = np.zeros(len(keys), np.int64)
        np.bitwise_or.at(mask, who[order][gone], np.int64(1) << offset[order][gone])
        hit = pa.array(mask != 0)
        return pa.RecordBatch.from_arrays([table["key"].combine_chunks().filter(hit), table["context"].combine_chunks().filter(hit), pa.array(mask).filter(hit)], names=["key", "context", "mask"])

    carried: pa.Table | None = None
    for batch in batches:
        # A few thousand contexts at a time: their places take some 100 bytes each in numpy.
        for a in range(0, batch.num_rows, FEW):
            own = pa.Table.from_batches([batch.slice(a, FEW)])
            table = own if carried is None else pa.concat_tables([carried, own])
            keys = table["key"].to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            carried = table.slice(cut)
            if cut:
                yield masks(table.slice(0, cut))
    if carried is not None and carried.num_rows:
        yield masks(carried)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of contexts as rows, for anchors with more contexts than a task should hold."""
    for batch in batches:
        for k in range(batch.num_rows):
            data, before = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
            many = max(0, len(data) - LENGTH + 1)
            offsets = [STRINGS - 1 - before + j for j in range(many)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([batch.column(c)[k].as_py()] * many, pa.int64()) for c in range(3)), pa.array(offsets, pa.int32()), pa.array([data[j : j + LENGTH] for j in range(many)], pa.binary())], names=["key", "context", "owner", "offset", "bytes"]
            )


def covered(n_bytes: int, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """``(start, end)`` of the maximal covered runs of a text of ``n_bytes``."""
    bits = (masks[:, None] >> np.arange(STRINGS)) & 1
    at, offset = np.nonzero(bits)
    starts = np.unique(places[at] - (STRINGS - 1) + offset)
    starts = starts[(starts >= 0) & (starts + LENGTH <= n_bytes)]
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return np.stack([starts[np.concatenate([[0], breaks])], starts[np.concatenate([breaks - 1, [len(starts) - 1]])] + LENGTH], 1)


def _slice(documents: DataFrame) -> Column:
    """The number of a row's slice: SLICE_ROWS rows of one file; TOGETHER neighbours differ in the low bits only."""
    block = F.floor(documents["_metadata.row_index"] / SLICE_ROWS).cast("bigint")
    far = F.xxhash64(documents["_metadata.file_path"], F.floor(block / TOGETHER).cast("bigint"))
    return far.bitwiseAND(F.lit(-TOGETHER)).bitwiseOR(F.pmod(block, F.lit(TOGETHER)).cast("bigint"))


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SliceTable:
    """For rows with removable strings ``slice, row`` and their anchors' ``places`` and ``masks``, to be looked up by slice."""
    spark = documents.sparkSession
    work = shared_dir(spark, "suffix-dedup")
    rows = documents.select(
        _slice(documents).alias("slice"), F.col("_metadata.row_index").alias("row"), F.coalesce(documents[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(documents[text_col], F.lit("")).alias("text")
    )
    size = data_bytes(documents, text_col)
    parts, files = partitions_for(spark, size, 8e6), partitions_for(spark, size, 64e6)
    blobs = rows.select("slice", "text").mapInArrow(tidied(lambda it: _bucket_blobs(it, parts)), "part int, slice bigint, one binary, several binary")
    shared = write_slices(blobs.groupBy("part").applyInArrow(_shared_buckets, "slice bigint, part int, keys binary"), f"{work}/shared", files, TOGETHER)

    schema = "slice bigint, row bigint, id bigint, place bigint, key bigint, context bigint"
    found = staged(rows.mapInArrow(tidied(lambda it: _contexts(it, shared, parts)), schema), f"{work}/contexts")
    drop_path(spark, f"{work}/shared")

    # A context's owner is its smallest document; the bytes of contested ones come from there, once.
    owners = staged(found.groupBy("key", "context").agg(F.min(F.struct("id", "slice", "row", "place")).alias("at")), f"{work}/owners")
    open_keys = owners.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.min("at.id").alias("lo"), F.max("at.id").alias("hi")).where("contexts > 1 and lo < hi").select("key", "contexts")
    spots = owners.join(open_keys, "key").select("at.slice", "at.row", "at.place", "key", "context", F.col("at.id").alias("owner"), "contexts")
    spots = write_slices(spots, f"{work}/spots", files, TOGETHER)
    schema = "key bigint, context bigint, owner bigint, contexts bigint, bytes binary, before int"
    held = staged(rows.select("slice", "row", "text").mapInArrow(tidied(lambda it: _context_bytes(it, spots)), schema), f"{work}/unsettled")
    drop_path(spark, f"{work}/spots")
    few = held.where(f"contexts <= {FEW}").drop("contexts").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidied(_refined), "key bigint, context bigint, mask bigint")
    strings = staged(held.where(f"contexts > {FEW}").select("key", "context", "owner", "bytes", "before").mapInArrow(_exploded, "key bigint, context bigint, owner bigint, offset int, bytes binary"), f"{work}/strings")
    least = strings.groupBy("key", "offset", "bytes").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select("key", "offset", "bytes", "least")
    many = strings.join(least, ["key", "offset", "bytes"]).where("least < owner").groupBy("key", "context").agg(F.expr("bit_or(shiftleft(1L, offset))").alias("mask"))
    settled = staged(owners.join(few.unionAll(many), ["key", "context"], "left").select("key", "context", F.col("at.id").alias("owner"), F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask")), f"{work}/settled")
    drop_path(spark, *(f"{work}/{x}" for x in ("owners", "unsettled", "strings")))

    masked = found.join(settled, ["key", "context"]).select("slice", "row", "place", F.expr(f"if(owner < id, {ALL}L, mask)").alias("mask")).where("mask != 0")
    hits = write_slices(masked.groupBy("slice", "row").agg(F.collect_list("place").alias("places"), F.collect_list("mask").alias("masks")), f"{work}/hits", files, TOGETHER)
    drop_path(spark, f"{work}/contexts", f"{work}/settled")
    return hits


def _spans(slices: np.ndarray, rows: np.ndarray, texts: pa.Array, hits: SliceTable) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text's bytes and removed runs."""
    for i, j in _runs(slices):
        table = hits.rows(int(slices[i]))
        found = {r: k for k, r in enumerate(table["row"].to_pylist())}
        places, masks = (table[x].combine_chunks() if table.num_rows else None for x in ("places", "masks"))
        for k in range(i, j):
            data = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            at = found.get(int(rows[k]))
            yield data, np.zeros((0, 2), np.int64) if at is None else covered(len(data), places[at].values.to_numpy(), masks[at].values.to_numpy())


def suffix_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text when strings of 50 bytes that a smaller document has are removed.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256``. Every byte goes that a 50-byte string covers which also
    starts in a document with a smaller id; strings are judged on the input,
    overlaps count, and none crosses documents. Null and short texts lose
    nothing; a null id is smaller than any other; rows of one id are no smaller
    than each other; an empty table gives no rows; other columns are not read.
    ``documents`` must be read from files (rows are told apart by file and
    number), and the working folder be one that pyarrow can read.
    """
    hits = repeated_spans(documents, id_col, text_col)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in _spans(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3), hits):
                ends = np.concatenate([[0], spans.ravel(), [len(data)]]).tolist()
                digest = hashlib.sha256()
                for a, b in zip(ends[::2], ends[1::2], strict=True):
                    digest.update(data[a:b])
                out.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = documents.select(_slice(documents).alias("slice"), F.col("_metadata.row_index").alias("row"), documents[id_col].cast("bigint").alias("id"), documents[text_col].alias("text"))
    return rows.mapInArrow(tidied(report), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _without(data: bytes, spans: np.ndarray) -> bytes:
    """The bytes outside the spans; a character goes if all its bytes do."""
    kept, at = [], 0
    for a, b in spans.tolist():
        # Bytes 10xxxxxx go on with a character: one that begins before or ends behind the span stays whole.
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = max(at, b)
    return b"".join(kept) + data[at:]


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The input with repeated strings cut out of its texts; a character goes if all its bytes do.

    Rows and columns stay, each row once, whatever rows share its id. As in
    suffix_dedup(), rows of one id are no smaller than each other, so neither
    loses what only they have in common. Null texts stay null. ``length_col``,
    if there, is set to the new number of characters of changed texts.
    """
    hits = repeated_spans(documents, id_col, text_col)
    names, types = documents.columns, documents.schema
    text_at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.columns[: len(names)], batch.column(text_at)
            changed = [_without(data, spans).decode() if len(spans) else None for data, spans in _spans(batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy(), texts, hits)]
            is_cut = np.array([x is not None for x in changed], bool)
            if is_cut.any():
                columns[text_at] = pa.array([new if new is not None else old.as_py() for new, old in zip(changed, texts, strict=True)], texts.type)
                if length_at is not None:
                    old = columns[length_at]
                    columns[length_at] = pa.array([len(x) if x is not None else y for x, y in zip(changed, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(names))])

    # Numbered names inside, as the input's may clash.
    rows = documents.select(*(documents[c] for c in names), _slice(documents).alias("slice"), F.col("_metadata.row_index").alias("row")).toDF(*(f"c{k}" for k in range(len(names) + 2)))
    schema = rows.schema[: len(names)]
    return rows.mapInArrow(tidied(cut), schema).toDF(*types.names)
