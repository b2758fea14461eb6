"""Block levels, running clocks, integrity folds and order checks of ordered streams.

Every operator partitions by the stream's key once; window and grouping share
that exchange. A stream's rows are ordered by the columns given, which must
tell its rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_levels(df: DataFrame, key: str, order: Sequence[str], value: str, size: int = 40, limit: float = 1.0) -> DataFrame:
    """``key, block, n, peak, rms, over``: peak, root mean square and values beyond ``limit`` of each ``size`` rows."""
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    blocks = df.select(key, F.floor((row - 1) / size).cast("bigint").alias("block"), F.col(value).alias("v"))
    return blocks.groupBy(key, "block").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count_if(F.abs("v") > limit).alias("over")
    )


def clock(df: DataFrame, key: str, order: Sequence[str], samples: str) -> DataFrame:
    """The input with ``first_sample``, the samples of all rows before."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("first_sample", F.coalesce(F.sum(samples).over(before), F.lit(0)))


def xor_fold(value: Column, channel: Column) -> Column:
    """An order-free checksum of 24-bit values, each shifted by its channel modulo 8, folded to a byte."""
    folded = F.bit_xor(F.call_function("shiftleft", value.cast("bigint").bitwiseAND(F.lit(2**24 - 1)), channel.cast("int") % 8))
    out = folded
    for n in (8, 16, 24):
        out = out.bitwiseXOR(F.shiftright(folded, n))
    return out.bitwiseAND(F.lit(255))


def next_check(df: DataFrame, key: str, order: str, expected: str, actual: str) -> DataFrame:
    """The input with ``verdict``: whether ``actual`` is what the next row expects; null for the last row."""
    ahead = F.lead(expected).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("verdict", F.when(ahead.isNotNull(), ahead == F.col(actual)))


def agreement(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, agree``: whether all rows of a key have the same values; null is a value of its own."""
    same = [F.min(c).eqNullSafe(F.max(c)) & (F.count_if(F.col(c).isNull()).isin(0) | (F.count(c) == 0)) for c in columns]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return df.groupBy(key).agg(out.alias("agree"))


def order_gate(df: DataFrame, key: str, order: Sequence[str], end: str) -> DataFrame:
    """The input with ``rising``: whether ``end`` is above that of the row before; true for the first, null where either end is."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rising", F.when(F.row_number().over(w) == 1, F.lit(True)).otherwise(F.lag(end).over(w) < F.col(end)))


def after_end(df: DataFrame, key: str, position: str, is_end: Column) -> DataFrame:
    """The rows that stand after their stream's first end mark."""
    first = F.min(F.when(is_end, F.col(position))).over(Window.partitionBy(key))
    return df.withColumn("end_at", first).where(F.col(position) > F.col("end_at"))


def residual(df: DataFrame, key: str, order: Sequence[str], value: str, taps: Sequence[int], shift: int) -> DataFrame:
    """The input with ``residual``: ``value`` less the floor-shifted prediction from the rows before.

    Rows before the first count as 0.
    """
    w = Window.partitionBy(key).orderBy(*order)
    predicted = F.lit(0).cast("bigint")
    for k, tap in enumerate(taps, 1):
        predicted = predicted + F.coalesce(F.lag(value, k).over(w), F.lit(0)).cast("bigint") * F.lit(tap)
    return df.withColumn("residual", F.col(value) - F.shiftright(predicted, shift))


def energies(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """``key, energy``: the sum of squares of a group's values."""
    return df.groupBy(*key).agg(F.sum(F.col(value) * F.col(value)).alias("energy"))


def reconstruct(df: DataFrame, key: str, order: Sequence[str], value: str, fir: Sequence[int], iir: Sequence[int], shift: int, clear_bits: int = 0) -> DataFrame:
    """``key, order, restored``: samples from residuals, by a recursive filter over what it has restored.

    A sample is its residual plus the floor-shifted sum of ``fir`` over the
    samples before and ``iir`` over the differences before (sample less
    prediction), low bits of the prediction cleared, wrapped to 32 bits. Rows
    stream by in order with one state a key; before the first all is 0.
    """
    from collections.abc import Iterator

    import pandas as pd

    names = [key, *order, value]
    types = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names[:-1])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, samples, rest = None, [], []
        for batch in batches:
            out = []
            for k, r in zip(batch[key], batch[value], strict=True):
                if k != last:
                    last, samples, rest = k, [0] * len(fir), [0] * len(iir)
                predicted = (sum(a * b for a, b in zip(fir, samples, strict=True)) + sum(a * b for a, b in zip(iir, rest, strict=True))) >> shift
                x = int(r) + (predicted & ~((1 << clear_bits) - 1))
                x = ((x + 2**31) & (2**32 - 1)) - 2**31
                samples, rest = ([x, *samples[:-1]] if fir else []), ([x - predicted, *rest[:-1]] if iir else [])
                out.append(x)
            yield batch.drop(columns=[value]).assign(restored=out)

    return df.select(*names).repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, f"{types}, restored bigint")
