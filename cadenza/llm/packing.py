"""Best-fit packing of documents into sequences of a fixed number of tokens.

Pieces of one length are interchangeable, so bins are planned on the histogram
of lengths (as many counts as the capacity, whatever the corpus's size) and the
plan is then dealt out to the pieces by their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.chunks import byte_table, encoded, space_chunks
from cadenza.llm.common import shared_dir, staged, tidied

PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def _total(plan: list[tuple[list[int], int]]) -> int:
    return sum(bins for _, bins in plan)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as ``(lengths in their order, number of such bins)`` for ``counts[length]`` pieces.

    Large-item matching with best fit, see matched_bins(). Where that takes
    more bins than the tokens need, filled_bins() is tried too, and the plan
    with fewer bins is taken.
    """
    plan = matched_bins(counts, capacity)
    if _total(plan) <= -(-sum(n * c for n, c in counts.items()) // capacity):
        return plan
    return min(plan, filled_bins(counts, capacity), key=_total)


def filled_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The longest piece left, and of the other pieces those that fill its bin best, in as many bins as there are pieces for.

    What sums can be made is one integer's bits, for each length in turn, the
    longest first, up to the first that fills the bin. Each pattern uses some
    length up below what it needs, so patterns are a few a length.
    """
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        target, sums = capacity - longest, 1
        steps: list[tuple[int, int, int]] = []
        for n in sorted((n for n in left if n <= target), reverse=True):
            many, each = min(left[n] - (n == longest), target // max(n, 1)), 1
            while many > 0 and not sums >> target & 1:
                take = min(each, many)
                steps.append((n, take, sums))
                sums |= (sums << n * take) & ((2 << target) - 1)
                many, each = many - take, 2 * each
        at, used = sums.bit_length() - 1, {longest: 1}
        for n, take, before in reversed(steps):
            if not before >> at & 1:
                at -= n * take
                used[n] = used.get(n, 0) + take
        bins = min(left[n] // c for n, c in used.items())
        out.append(([n for n in sorted(used, reverse=True) for _ in range(used[n])], bins))
        for n, c in used.items():
            left[n] -= bins * c
            if not left[n]:
                del left[n]
    return out


def matched_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as ``(lengths in their order, number of such bins)`` for ``counts[length]`` pieces.

    Large-item matching: pieces above a third of the capacity, of which at most
    two fit in a bin, are matched from the longest on, each with the longest
    other that still fits. Smaller pieces, longest first, then go to the bin
    with the smallest gap that takes them; a new bin opens only when no gap
    does. All is done for whole counts at once.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    # A pattern is (its last length, the pattern before); gaps[g] lists [pattern, bins] with g tokens free.
    gaps: dict[int, list[list]] = {}

    def put(gap: int, pattern: tuple, bins: int) -> None:
        if gap not in gaps:
            bisect.insort(order, gap)
            gaps[gap] = []
        gaps[gap].append([pattern, bins])

    order: list[int] = []
    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left.get(n, 0):
            k = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while k >= 0 and left[large[k]] < 1 + (large[k] == n):
                k -= 1
            if k < 0:
                put(capacity - n, (n, None), left[n])
                left[n] = 0
            else:
                m = large[k]
                bins = left[n] // 2 if m == n else min(left[n], left[m])
                put(capacity - n - m, (m, (n, None)), bins)
                left[n] -= bins
                left[m] -= bins
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                each = capacity // n if n else 1
                full, rest = divmod(left[n], each)
                for bins, many in ((full, each), (1, rest)):
                    if bins and many:
                        pattern = None
                        for _ in range(many):
                            pattern = (n, pattern)
                        put(capacity - n * many, pattern, bins)
                left[n] = 0
                break
            gap = order[k]
            pattern, bins = gaps[gap].pop()
            used = min(bins, left[n])
            if used < bins:
                gaps[gap].append([pattern, bins - used])
            if not gaps[gap]:
                del gaps[gap], order[k]
            put(gap - n, (n, pattern), used)
            left[n] -= used
    out = []
    for gap in sorted(gaps):
        for pattern, bins in gaps[gap]:
            lengths = []
            while pattern:
                lengths.append(pattern[0])
                pattern = pattern[1]
            out.append((lengths[::-1], bins))
    return out


def cut_pieces(documents: DataFrame, ranks_path: str, pattern: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Every document's ids and ``end_id``, cut where longer than ``capacity``; only the first piece may be shorter."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks_path, pattern, added=added)
        for batch in batches:
            for a, ids, bounds in encoded(batch.column(1), table, space_chunks):
                rows: list[tuple] = []
                for k, name in enumerate(batch.column(0).slice(a, len(bounds) - 1).to_pylist()):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], end_id).astype("<u4")
                    first = len(own) % capacity or capacity
                    starts = [0, *range(first, len(own), capacity)]
                    for piece, (i, j) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True)):
                        data = own[i:j].tobytes()
                        rows.append((name, piece, i, j - i, zlib.crc32(data)) + ((data,) if with_ids else ()))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names[: len(columns)])

    return documents.select(documents[id_col].cast("bigint"), documents[text_col]).mapInArrow(tidied(pieces), PIECES + (", ids binary" if with_ids else ""))


def pack_documents(
    documents: DataFrame, ranks_path: str, pattern: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, n_salts: int = 64, added: tuple[tuple[str, int], ...] = ()
) -> DataFrame:
    """Pack every document's tokens into as few sequences of ``capacity`` as best-fit finds.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` (and ``ids``, little-endian unsigned 32-bit, with
    ``with_ids``). Null texts count as empty: a piece that is the end id alone.
    Strings of ``added`` tokens in a text get those tokens' ids.
    Null ids and repeated rows are packed as documents of their own; an empty
    table gives no rows; other columns are not read. Ties between pieces of a
    length are dealt by id, piece and salt. What goes to the driver is the
    histogram of lengths (at most ``capacity`` counts).
    """
    spark = documents.sparkSession
    pieces = staged(cut_pieces(documents, ranks_path, pattern, end_id, capacity, id_col, text_col, with_ids, added), shared_dir(spark, "pieces"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_salts)).cast("int"))
    tally = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, sequence, ranks = [], 0, dict.fromkeys(counts, 0)
    for lengths, bins in plan_bins(counts, capacity):
        offset = 0
        for n in lengths:
            rows.append((n, ranks[n], bins, sequence, offset))
            ranks[n] += bins
            offset += n
        sequence += bins
    # Slot rows cut into blocks of ranks, so that a piece meets the few slots of its block only.
    plan = spark.createDataFrame(rows, "length int, first bigint, bins bigint, sequence bigint, offset bigint")
    block = max(1024, max(counts.values(), default=1) // 4096)
    slots = plan.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + bins - 1) div {block}"))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("rn", F.row_number().over(order) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("rn") + F.col("base"))
        .withColumn("block", F.expr(f"rank div {block}"))
    )
    found = ranked.join(slots, ["length", "block"]).where("rank >= first and rank < first + bins")
    columns = ["doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("offset").cast("bigint").alias("offset")]
    return found.select(*columns, *(["ids"] if with_ids else []))
