"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments. Two codes that differ in d bits differ in at most
d // m bits in one of the m segments, so looking up, in turn, every segment
value at distance 0, 1, 2, ... from the query's finds all codes up to a radius
that grows by one with every segment looked up. A query ends when its k-th
verified distance is within that radius.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import shared_dir, spans_to_index, staged

#: Queries looked up together, and probes at once; bound a task's memory.
QUERIES, PROBES = 128, 400_000
#: Codes below which a block is not cut further.
LEAST_ROWS = 1000


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str, n_bits: int = 64) -> DataFrame:
    """``id, code``: bit i is set where component i is above 0; null vectors have no code, missing or null components are 0."""
    bits = [F.when(F.coalesce(F.get(vectors[vector_col], F.lit(i)), F.lit(0.0)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint") for i in range(n_bits)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return vectors.where(vectors[vector_col].isNotNull()).select(vectors[id_col].cast("bigint").alias("id"), code.alias("code"))


class SegmentIndex:
    """Codes of one block, by the value of each of their segments."""

    def __init__(self, codes: np.ndarray, n_bits: int):
        self.codes = codes
        width = max(1, min(20, round(math.log2(max(2, len(codes))))))
        m = math.ceil(n_bits / width)
        cuts = [round(j * n_bits / m) for j in range(m + 1)]
        self.segments = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            values = self.values(codes, lo, hi)
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << (hi - lo)) + 1))
            self.segments.append((lo, hi, order, starts))

    @staticmethod
    def values(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((codes >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def nearest(self, queries: np.ndarray, k: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``(query, code, distance)``: of each query the k nearest codes within its limit, ties by place in the block.

        A query ends when its radius covers its k-th verified distance here or
        its limit, whichever is less.
        """
        n, m = len(self.codes), len(self.segments)
        k = min(k, n)
        best = np.full((len(queries), k), np.iinfo(np.int64).max)
        active = np.arange(len(queries))
        for radius in range(max(hi - lo for lo, hi, *_ in self.segments) + 1):
            for j, (lo, hi, order, starts) in enumerate(self.segments):
                if not len(active):
                    break
                flips = np.array([sum(1 << b for b in bits) for bits in combinations(range(hi - lo), radius)], np.int64)
                own = self.values(queries[active], lo, hi)
                for a in range(0, len(active), step := max(1, PROBES // max(1, len(flips)))):
                    if not len(flips):
                        break
                    rows = active[a : a + step]
                    probes = (own[a : a + step, None] ^ flips).ravel()
                    first, many = starts[probes], starts[probes + 1] - starts[probes]
                    who = np.repeat(np.repeat(rows, len(flips)), many)
                    found = order[spans_to_index(first, many)]
                    distance = np.bitwise_count(queries[who] ^ self.codes[found]).astype(np.int64)
                    # The key holds distance and place; what can't enter a query's best k goes at once.
                    key = distance * n + found
                    near = (key < best[who, -1]) & (distance <= limits[who])
                    self._merge(best, who[near], key[near])
                covered = m * radius + j
                active = active[np.minimum(best[active, -1] // n, limits[active]) > covered]
        who, best = np.repeat(np.arange(len(queries)), k), best.ravel()
        met = best < np.iinfo(np.int64).max
        return who[met], best[met] % n, best[met] // n

    @staticmethod
    def _merge(best: np.ndarray, who: np.ndarray, key: np.ndarray) -> None:
        if not len(who):
            return
        rows = np.unique(who)
        k = best.shape[1]
        who = np.concatenate([who, np.repeat(rows, k)])
        key = np.concatenate([key, best[rows].ravel()])
        order = np.lexsort((key, who))
        who, key = who[order], key[order]
        last = key == np.iinfo(np.int64).max
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (key[1:] != key[:-1])]) | last
        who, key = who[new], key[new]
        begins = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rank = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
        keep = rank < k
        best[who[keep], rank[keep]] = key[keep]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, n_bits: int = 64, block_rows: int = 500_000, query_rows: int = 20_000) -> DataFrame:
    """The ``k`` nearest other rows of every query by Hamming distance, exactly; ties go to the smaller id.

    ``codes`` and ``queries`` have ``id`` and ``code``. Returns ``query_id,
    rank, neighbor_id, distance``. A row is no neighbour of the query with its
    own id; null ids take no part; rows with one id and code count once; fewer
    than k other rows give fewer; empty tables give no rows. Rows of one code
    are folded to the k + 1 smallest ids before anything is shuffled, so a very
    common code costs no more than another. Index and queries are dealt out in
    blocks; each pair of blocks is a task of bounded size. A query is first
    searched in one block, whose (k + 1)-th distance bounds it in all others:
    they end at that radius and emit no code beyond it.
    """
    spark = codes.sparkSession
    work = shared_dir(spark, "hamming")
    by_id = Window.partitionBy("code").orderBy("id")
    few = codes.where("id is not null").distinct().withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    index = staged(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), f"{work}/index")
    asked = staged(queries.where("id is not null").select("id", "code").distinct(), f"{work}/queries")
    n_codes, n_asked = index.count(), asked.select("code").distinct().count()
    n_blocks = max(1, min(math.ceil(n_codes / LEAST_ROWS), max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_codes / block_rows))))
    n_groups = max(1, math.ceil(n_asked / query_rows))
    home = F.pmod(F.xxhash64("code"), F.lit(n_blocks))
    least = F.col("ids")[0].alias("least")
    number = min(100_000, max(n_blocks * n_groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "asked_code bigint, code bigint, distance int"

    def search(table: pa.Table) -> pa.Table:
        code, limit = table["code"].to_numpy().view(np.uint64), table["limit"].to_numpy()
        is_query = limit >= 0
        order = np.argsort(table["least"].to_numpy()[~is_query], kind="stable")
        block, ordered = code[~is_query][order], np.argsort(code[is_query], kind="stable")
        wanted, limits = code[is_query][ordered], limit[is_query][ordered]
        parts: list[list[np.ndarray]] = [[], [], []]
        if len(block) and len(wanted):
            segments = SegmentIndex(block, n_bits)
            for a in range(0, len(wanted), QUERIES):
                who, found, distance = segments.nearest(wanted[a : a + QUERIES], k + 1, limits[a : a + QUERIES])
                for part, x in zip(parts, (wanted[a + who].view(np.int64), block[found].view(np.int64), distance.astype(np.int32)), strict=True):
                    part.append(x)
        types = (np.int64, np.int64, np.int32)
        return pa.table([np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)], names=["asked_code", "code", "distance"])

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        # Dealt by number, which adaptive execution leaves as it is: small groups would else meet in one task.
        both = left.select("code", "block", "part", F.lit(-1).alias("limit"), "least").unionByName(right.select("code", "block", "part", "limit", F.lit(None).cast("bigint").alias("least")))
        return both.repartition(number, "block", "part").groupBy("block", "part").applyInArrow(search, schema)

    codes_asked = asked.select("code").distinct()
    group = F.pmod(F.xxhash64("code"), F.lit(n_groups)).cast("int").alias("part")
    blocks = index.select("code", home.alias("block"), least)
    # The first block of a query is that of its own code.
    first = staged(searched(blocks.withColumn("part", F.lit(0)), codes_asked.select("code", home.alias("block"), F.lit(0).alias("part"), F.lit(n_bits).alias("limit"))), f"{work}/first")
    bounds = first.groupBy("asked_code").agg(F.when(F.count(F.lit(1)) > k, F.max("distance")).otherwise(F.lit(n_bits)).alias("limit"))
    bounded = codes_asked.join(bounds.withColumnRenamed("asked_code", "code"), "code", "left").select("code", home.alias("home"), group, F.coalesce("limit", F.lit(n_bits)).alias("limit"))
    others = bounded.withColumn("block", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)"))).where("block != home").drop("home")
    near = first.unionAll(searched(blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))), others))
    # k + 1 codes of the smallest (distance, smallest id) hold the k + 1 nearest rows.
    per_code = Window.partitionBy("asked_code").orderBy("distance", "least", "code")
    held = near.join(index, "code").withColumn("least", F.col("ids")[0]).withColumn("nth", F.row_number().over(per_code)).where(F.col("nth") <= k + 1)
    folded = held.groupBy("asked_code").agg(F.collect_list(F.struct("distance", "ids")).alias("held"))
    per_query = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    pairs = (
        asked.join(folded, asked["code"] == folded["asked_code"])
        .select(F.col("id").alias("query_id"), F.explode("held").alias("held"))
        .select("query_id", F.col("held.distance").alias("distance"), F.explode("held.ids").alias("neighbor_id"))
        .where("query_id != neighbor_id")
        .groupBy("query_id", "neighbor_id")
        .agg(F.min("distance").alias("distance"))
    )
    return pairs.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


