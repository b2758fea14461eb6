"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

A text is the multiset of its five-word shingles. Every shingle, with its count
as weight, sends points of a Poisson process of that rate to random components;
the earliest point of a component decides it. Points come in order of time and
end as soon as no component can still improve, so two signatures agree in a
component with the probability Jaccard similarity of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SLICE_BYTES, at_locator, byte_lengths, drop_path, shared_dir, spans_to_index, staged, text_bytes, text_slices, tidied, utf8
from cadenza.llm.hashing import Bytes, mix, words

COMPONENTS, ROWS_A_BAND = 96, 4
#: Members of a bucket compared pair by pair at once, and from which size on that is done in blocks.
BLOCK, SMALL = 512, 16
#: Components of the finer signature that tells members of large buckets apart, and texts that get theirs at once.
FINE, FINE_TEXTS = 1024, 1024


def shingles(texts: pa.Array, n_words: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a text column: distinct shingle keys (44 bits, ascending in each text), their counts, and shingles per text.

    Words are lower-cased and stand between ASCII white space. A text of fewer
    words than ``n_words`` is one shingle, a text without words has none.
    """
    lower = pc.utf8_lower(utf8(texts))
    for a, b in text_slices(byte_lengths(lower), SLICE_BYTES):
        raw, bounds = text_bytes(lower.slice(a, b - a))
        starts, ends, counts = words(raw, bounds)
        hashed = Bytes(raw).hashes(starts, ends)
        many = np.where(counts == 0, 0, np.maximum(counts - n_words + 1, 1))
        first = spans_to_index(np.cumsum(counts) - counts, many)
        text = np.repeat(np.arange(b - a, dtype=np.uint64), many)
        stop = np.repeat(np.cumsum(counts), many)
        key = np.zeros(len(first), np.uint64)
        for j in range(n_words):
            within = first + j < stop
            word = hashed[np.minimum(first + j, len(hashed) - 1)] if len(hashed) else hashed
            key = mix(key + np.where(within, word, np.uint64(j)))
        ordered = np.sort((text << np.uint64(44)) | (key >> np.uint64(20)))
        new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        distinct = ordered[new]
        per_text = np.bincount((distinct >> np.uint64(44)).astype(np.int64), minlength=b - a)
        yield distinct & np.uint64((1 << 44) - 1), np.diff(np.append(new, len(ordered))), per_text


def prob_minhash(keys: np.ndarray, weights: np.ndarray, per_text: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (texts x m, uint32); a text without shingles has zeros."""
    n = len(per_text)
    earliest, chosen = np.full(n * m, np.inf), np.zeros(n * m, np.uint32)
    text = np.repeat(np.arange(n), per_text)
    time, active, limit = np.zeros(len(keys)), np.arange(len(keys)), np.full(n, np.inf)
    arrival = np.uint64(0)
    while len(active):
        arrival += np.uint64(1)
        drawn = mix(keys[active] * np.uint64(0xD6E8FEB86659FD93) + arrival)
        uniform = ((drawn >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
        now = time[active] - np.log(uniform) / weights[active]
        soon = now < limit[text[active]]
        active, now, drawn = active[soon], now[soon], drawn[soon]
        time[active] = now
        slot = text[active] * m + ((mix(drawn) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, slot, now)
        won = earliest[slot] == now
        chosen[slot[won]] = (keys[active[won]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        limit = earliest.reshape(n, m).max(1)
        active = active[time[active] < limit[text[active]]]
    return chosen.reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets ``(ascending keys, weights)``; for equal weights the Jaccard similarity."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1] / a[1].sum()
    y[np.searchsorted(keys, b[0])] = b[1] / b[1].sum()
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    last = np.searchsorted(ratio, ratio, "right")
    below, above = np.cumsum(x)[last - 1], y.sum() - np.cumsum(y)[last - 1]
    both = (x > 0) & (y > 0)
    return float((1 / (below[both] / x[both] + above[both] / y[both])).sum())


def _signatures(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for keys, counts, per_text in shingles(batch.column(4), n_words):
            k = len(per_text)
            flat = prob_minhash(keys, counts.astype(np.float64), per_text)
            signature = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COMPONENTS), k, [None, pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, k) for c in range(4)), pa.array(per_text > 0), signature], names=["id", "file", "row", "digest", "has_words", "signature"])
            at += k


def _fine_signatures(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    """Of ``node, text``: the low byte of each of FINE components."""
    for batch in batches:
        at = 0
        for keys, counts, per_text in shingles(batch.column(1), n_words):
            ends = np.concatenate([[0], np.cumsum(per_text)])
            for a in range(0, len(per_text), FINE_TEXTS):
                b = min(a + FINE_TEXTS, len(per_text))
                part = slice(ends[a], ends[b])
                flat = prob_minhash(keys[part], counts[part].astype(np.float64), per_text[a:b], FINE).astype(np.uint8)
                fine = pa.FixedSizeBinaryArray.from_buffers(pa.binary(FINE), b - a, [None, pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at + a, b - a), fine], names=["node", "fine"])
            at += len(per_text)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COMPONENTS)


def components(edges: DataFrame, work: str) -> DataFrame:
    """``node, class`` (the smallest node that it is linked with) of all nodes of ``edges`` (``a, b``).

    Large-star and small-star steps in turn, each written to the shared folder,
    until the edges no longer change; they are then stars around the smallest
    nodes. Steps group by node with partial minima; a hub's own edges meet it in a
    join, which adaptive execution splits where it is skewed.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{work}/edges-0")
    seen, step = None, 0
    while True:
        step += 1
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionAll(least.where("a != m").select("a", F.col("m").alias("b"))).distinct()
        large = staged(large, f"{work}/large-{step}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        now = staged(small, f"{work}/edges-{step}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("class")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())
        seen = state


def _estimated(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """Pairs ``a, b`` whose signatures agree in ``floor`` of the components at least."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(1)
            yield batch.select([0, 1]).filter(pa.array(same >= floor))

    left, right = (nodes.select(F.col("node").alias(x), F.col("signature").alias(f"signature_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "signature_a", "signature_b").mapInArrow(tidied(near), "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, n_words: int) -> DataFrame:
    """Pairs ``a, b`` whose probability Jaccard similarity is ``threshold`` at least.

    The members of a common ``b`` are salted into groups of about 256, each
    with a copy of its text, and stream by in order.
    """
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(many, "b").select("a", "b", F.expr("pmod(xxhash64(a), cast(ceil(n / 256) as bigint))").alias("salt"))
    held = texts.select(F.col("node").alias("a"), "text")
    members = salted.join(held, "a").select("b", "salt", "a", "text")
    heads = salted.select("b", "salt").distinct().join(held.withColumnRenamed("a", "b"), "b").select("b", "salt", F.lit(None).cast("bigint").alias("a"), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            sets = []
            for keys, counts, per_text in shingles(batch.column(3), n_words):
                ends = np.cumsum(per_text)
                sets += [(keys[e - n : e], counts[e - n : e]) for e, n in zip(ends.tolist(), per_text.tolist(), strict=True)]
            linked = np.zeros(batch.num_rows, bool)
            for k, a in enumerate(batch.column(2).to_pylist()):
                if a is None:
                    head = sets[k]
                else:
                    linked[k] = probability_jaccard(sets[k], head) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0)], names=["a", "b"]).filter(pa.array(linked))

    return members.unionAll(heads).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first()).mapInArrow(tidied(check), "a bigint, b bigint")


def _floor(threshold: float, m: int) -> float:
    """The share of m components that texts of that similarity agree in, but for one pair in 30,000."""
    return threshold - 4 * math.sqrt(threshold * (1 - threshold) / m)


def _pairs_in_blocks(open_buckets: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, n_words: int, work: str) -> DataFrame:
    """Pairs of different classes in large buckets, whose signatures are near, by blocks of members.

    Pairs that the first signature leaves are told apart by a finer one. A pair
    is given once, by the first of the bands that it agrees in.
    """
    signed = nodes.join(open_buckets.select("node").distinct(), "node", "left_semi").select("node", "signature")
    wanted = texts.join(open_buckets.select("node").distinct(), "node", "left_semi").select("node", "text")
    signed = staged(signed.join(wanted.mapInArrow(tidied(lambda it: _fine_signatures(it, n_words)), "node bigint, fine binary"), "node"), f"{work}/fine")
    sized = open_buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    salted = open_buckets.join(sized, ["band", "key"]).withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn("salt", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    # A member of block i goes to the groups (i, j) and (j, i) of all blocks j.
    dealt = salted.join(signed, "node").select("band", "key", "node", "class", "signature", "fine", F.col("salt").alias("own"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    floor, fine_floor = _floor(threshold, COMPONENTS), _floor(threshold, FINE)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        node, label, own = (table[x].to_numpy() for x in ("node", "class", "own"))
        i, j, band = (table[x][0].as_py() for x in ("i", "j", "band"))
        signatures = _matrix(table["signature"].combine_chunks())
        by_component = np.ascontiguousarray(signatures.T)
        fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint8).reshape(len(node), FINE)
        rows_a, rows_b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out_a, out_b = [], []
        for a in range(0, len(rows_a), 32):
            part = rows_a[a : a + 32]
            same = np.zeros((len(part), len(rows_b)), np.uint8)
            for values in by_component:
                same += values[part][:, None] == values[rows_b][None, :]
            near = (same >= floor * COMPONENTS) & (label[part][:, None] != label[rows_b][None, :]) & ((node[part][:, None] > node[rows_b][None, :]) | (i != j))
            x, y = np.nonzero(near)
            x, y = part[x], rows_b[y]
            for k in range(0, len(x), 4096):
                p, q = x[k : k + 4096], y[k : k + 4096]
                earlier = (signatures[p, : band * ROWS_A_BAND] == signatures[q, : band * ROWS_A_BAND]).reshape(len(p), band, ROWS_A_BAND).all(2).any(1)
                p, q = p[~earlier], q[~earlier]
                alike = (fine[p] == fine[q]).mean(1) >= fine_floor
                out_a.append(node[p[alike]])
                out_b.append(node[q[alike]])
        a, b = np.concatenate(out_a or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])
        return pa.table([np.maximum(a, b), np.minimum(a, b)], names=["a", "b"])

    return staged(dealt.groupBy("band", "key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct(), f"{work}/block-pairs")


def near_duplicates(documents: DataFrame, threshold: float = 0.8, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The near-duplicate class of every document.

    Returns one row per input row: ``doc_id, class_id, class_size, kept``.
    Documents are linked where the probability Jaccard similarity of their
    ``n_words``-word shingles is ``threshold`` at least; classes are the
    connected components, named by their smallest id, and that document is
    kept. Equal texts are folded before they are banded. Null and empty texts
    count as equal texts without words. A null id makes a class of its own,
    without links; an empty table gives no rows; other columns are not read.
    ``documents`` must be read from files: rows are told apart by file and
    number, so rows of one id with different texts are different documents (two
    classes may then have the same name), repeated rows count one by one, and
    of a class's rows with the smallest id the first by file and number alone
    is kept.

    Two texts meet if a band of their signatures is equal, which at a
    similarity of 0.8 fails for 3 pairs in a million. Within a bucket each
    member is compared with the one that meets most others; where that leaves members of one
    bucket in different classes, all their pairs across classes are compared,
    in blocks and by a finer signature. Before texts are compared, pairs go whose
    signatures agree in fewer components than those of a pair at the threshold
    do but once in 30,000 (``_floor``; in large buckets a second time, by the
    finer signature): of the links at the very threshold about 7 in 100,000 may
    be lost so, of closer texts far fewer. Every link given is verified.
    """
    return _verdicts(documents, threshold, n_words, id_col, text_col).drop("file", "row")


def _verdicts(documents: DataFrame, threshold: float, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of near_duplicates() with their locators ``file, row``."""
    spark = documents.sparkSession
    work = shared_dir(spark, "near-dup")
    locator = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = documents.select(documents[id_col].cast("bigint").alias("id"), *locator, F.coalesce(documents[text_col], F.lit("")).alias("text"))
    known = rows.where("id is not null")
    signed = staged(known.select("id", "file", "row", F.unhex(F.sha2("text", 256)).alias("digest"), "text").mapInArrow(tidied(lambda it: _signatures(it, n_words)), "id bigint, file string, row bigint, digest binary, has_words boolean, signature binary"), f"{work}/signed")
    by_text = signed.groupBy("digest").agg(F.min(F.struct("id", "file", "row")).alias("first"), F.first("has_words").alias("has_words"), F.first("signature").alias("signature"))
    # A text's node is its own even where texts share an id; written once, its number no longer changes.
    nodes = staged(by_text.withColumn("node", F.monotonically_increasing_id()), f"{work}/nodes")
    equal = staged(signed.select("id", "file", "row", "digest").join(nodes.select("digest", "node"), "digest").select("id", "file", "row", "node"), f"{work}/equal")
    drop_path(spark, f"{work}/signed")

    sign = F.expr(f"transform(sequence(0, {COMPONENTS // ROWS_A_BAND - 1}), b -> xxhash64(substring(signature, {4 * ROWS_A_BAND} * b + 1, {4 * ROWS_A_BAND})))")
    banded = nodes.where("has_words").select("node", F.posexplode(sign).alias("band", "key"))
    groups = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = staged(banded.join(groups, ["band", "key"]), f"{work}/met")
    # A bucket's head is the member that meets most others over all bands: nearest to the middle of its group.
    meets = met.groupBy("node").agg(F.sum("size").alias("meets"))
    heads = met.join(meets, "node").groupBy("band", "key").agg(F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("m")).select("band", "key", (-F.col("m.minus")).alias("head"))
    buckets = staged(met.join(heads, ["band", "key"]), f"{work}/buckets")

    drop_path(spark, f"{work}/met")
    floor = _floor(threshold, COMPONENTS)
    stars = buckets.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    star = staged(_estimated(stars, nodes, floor), f"{work}/star")
    involved = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "first.file", "first.row")
    texts = staged(known.join(involved, ["file", "row"]).select("node", "text"), f"{work}/texts")
    links = staged(_verified(star, texts, threshold, n_words), f"{work}/links")

    # Members of one bucket in different classes: the pairs that the stars left out.
    labels = staged(components(links, f"{work}/first"), f"{work}/labels")
    labelled = buckets.where("size > 2").join(labels, "node", "left").select("band", "key", "node", "size", F.coalesce("class", "node").alias("class"))
    split = labelled.groupBy("band", "key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("band", "key")
    loose = staged(labelled.join(split, ["band", "key"]), f"{work}/loose")
    few = loose.where(f"size <= {SMALL}")
    other = few.select("band", "key", F.col("node").alias("b"), F.col("class").alias("class_b"))
    pairs = few.join(other, ["band", "key"]).where("node > b and class != class_b").select(F.col("node").alias("a"), "b").distinct()
    wide = _pairs_in_blocks(loose.where(f"size > {SMALL}"), nodes, texts, threshold, n_words, work)
    rest = staged(_estimated(pairs, nodes, floor).unionAll(wide).distinct().join(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), f"{work}/rest")
    if not rest.isEmpty():
        more = staged(_verified(rest, texts, threshold, n_words), f"{work}/more")
        labels = staged(components(links.unionAll(more), f"{work}/second"), f"{work}/labels-2")
    drop_path(spark, *(f"{work}/{x}" for x in ("nodes", "buckets", "star", "texts", "links", "first", "loose", "fine", "block-pairs", "rest", "more", "second")))

    classed = equal.join(labels, "node", "left").select("id", "file", "row", F.coalesce("class", "node").alias("class"))
    classes = classed.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("id", "file", "row")).alias("keep"))
    kept = F.expr("file = keep.file and row = keep.row")
    found = classed.join(classes, "class").select(F.col("id").alias("doc_id"), F.col("keep.id").alias("class_id"), "class_size", kept.alias("kept"), "file", "row")
    lone = rows.where("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"), "file", "row")
    return found.unionAll(lone)


def keep_one_of_each_class(documents: DataFrame, threshold: float = 0.8, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without those of a class that keeps another row; verdicts are joined back by file and row number."""
    gone = _verdicts(documents, threshold, n_words, id_col, text_col).where("not kept").select("file", "row")
    return documents.join(gone, at_locator(documents, gone), "left_anti")
