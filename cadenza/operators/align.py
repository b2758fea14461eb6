"""Alignment of timed updates to samples: holds, fills, ramps and checkpoints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hold(df: DataFrame, key: str, order: Sequence[str], update: Column, name: str = "held") -> DataFrame:
    """The input with ``name``: the last non-null ``update`` at or before the row; null before the first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(update, ignorenulls=True).over(w))


def asof(samples: DataFrame, updates: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``samples`` with the latest update at or before each; an update at a sample comes before it.

    One exchange of the union of both sides: no pairs are made, whatever the number of updates.
    """
    extra = [c for c in samples.columns if c not in (key, at)]
    right = updates.select(key, at, F.col(value).alias("_value"), F.lit(0).alias("_kind"), *(F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in extra))
    left = samples.select(key, at, F.lit(None).cast(updates.schema[value].dataType).alias("_value"), F.lit(1).alias("_kind"), *extra)
    return hold(right.unionByName(left), key, [at, "_kind"], F.col("_value"), value).where("_kind = 1").drop("_kind", "_value")


def ramp(start: Column, target: Column, began: Column, duration: Column, now: Column) -> Column:
    """Linear from ``start`` at ``began`` to ``target`` after ``duration``; at once where that is 0."""
    share = F.when(duration <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (now - began) / duration)))
    return start + (target - start) * share


def interrupted_ramps(events: DataFrame, key: str, at: str, duration: str, target: str, arrival: str) -> DataFrame:
    """The events with ``origin``: where each ramp starts: at the value that the one before has then reached.

    A value is unknown until a ramp from a known value, a ramp that has ended,
    or a jump (duration 0) makes it known: the first event of a key has no
    origin, and neither has one that breaks off a ramp without one. Each origin
    depends on the one before, so a key's events stream by in order with one
    state a key (Arrow batches, no group in memory). Events at one time come in
    the order of ``arrival``.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("k"), F.col(at).cast("double").alias("t"), F.col(duration).cast("double").alias("d"), F.col(target).cast("double").alias("x"), F.col(arrival).cast("bigint").alias("n"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, origin, began, length, goal = None, None, 0.0, 0.0, 0.0
        for batch in batches:
            out = []
            for k, t, d, x in zip(batch["k"], batch["t"], batch["d"], batch["x"], strict=True):
                if k != last:
                    now, last = None, k
                elif length <= 0 or t - began >= length:
                    now = goal
                elif origin is None:
                    now = None
                else:
                    now = origin + (goal - origin) * (t - began) / length
                out.append(now)
                origin, began, length, goal = now, t, d, x
            yield batch.assign(origin=pd.array(out, "Float64")).astype({"origin": "float64"}).set_axis([key, at, duration, target, arrival, "origin"], axis=1)

    return rows.repartition("k").sortWithinPartitions("k", "t", "n").mapInPandas(fold, f"{key} {kind}, {at} double, {duration} double, {target} double, {arrival} bigint, origin double")


def positions_at(samples: DataFrame, events: DataFrame, key: str, at: str, duration: str, target: str, arrival: str) -> DataFrame:
    """``samples`` with ``position``: the value that timed ramps have reached at each; null while it isn't known.

    An event at a sample comes before it; of events at one time the last holds.
    """
    ramps = interrupted_ramps(events, key, at, duration, target, arrival)
    last = ramps.groupBy(key, at).agg(F.max_by(F.struct(F.col(at).alias("began"), F.col(duration).alias("d"), F.col(target).alias("x"), "origin"), arrival).alias("_ramp"))
    held = asof(samples.withColumn(at, F.col(at).cast("double")), last, key, at, "_ramp")
    r = lambda name: F.col(f"_ramp.{name}")
    over = (r("d") <= 0) | (F.col(at) - r("began") >= r("d"))
    return held.withColumn("position", F.when(over, r("x")).otherwise(ramp(r("origin"), r("x"), r("began"), r("d"), F.col(at)))).drop("_ramp")


def checkpoint_before(df: DataFrame, key: str, position: str, state: str, stride: int, target: Column, order: Sequence[str]) -> DataFrame:
    """``key, checkpoint, state``: of every ``stride``-th row of a key, the last one at or before ``target``."""
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    kept = df.withColumn("_row", row).where((F.col("_row") % stride == 0) & (F.col(position) <= target))
    return kept.groupBy(key).agg(F.max(position).alias("checkpoint"), F.max_by(state, position).alias("state"))


def thinned_checkpoints(df: DataFrame, key: str, position: str, stride: int, capacity: int) -> DataFrame:
    """Checkpoints every ``stride`` positions at least, thinned to every second one, and the stride doubled, when a key has ``capacity``.

    ``key, checkpoint, stride``. Doubling until all fit is one power of two a
    key: the smallest at which its rows give no more than ``capacity``.
    """
    span = df.groupBy(key).agg(F.max(position).alias("_last"), F.min(position).alias("_first"))
    need = F.greatest(F.lit(1.0), (F.col("_last") - F.col("_first")) / F.lit(float(stride * max(1, capacity - 1))))
    step = (F.pow(F.lit(2.0), F.ceil(F.log2(need))) * F.lit(stride)).cast("bigint")
    rows = df.join(span.withColumn("stride", step), key).withColumn("_cell", F.floor((F.col(position) - F.col("_first")) / F.col("stride")))
    return rows.groupBy(key, "stride", "_cell").agg(F.min(position).alias("checkpoint")).select(key, "checkpoint", "stride")


def pending_events(events: DataFrame, key: str, at: str, sample: str, arrival: str, capacity: int = 64) -> DataFrame:
    """``events`` with ``waiting``, the events announced before that were still to come, and ``fits``: whether a queue of ``capacity`` had room.

    An event is announced at ``at`` and leaves the queue once ``sample`` (its
    own announcement at the earliest, also where null) lies before the next
    one's ``at``; of events announced at once, those of smaller ``arrival``
    come before. One sweep over announcements and departures: no join.
    """
    leaves = F.greatest(F.col(at), F.coalesce(F.col(sample), F.col(at)))
    steps = F.array(F.struct(F.col(at).alias("pos"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(leaves.alias("pos"), F.lit(1).alias("kind"), F.lit(-1).alias("step")))
    before = Window.partitionBy(key).orderBy("_e.pos", "_e.kind", arrival).rowsBetween(Window.unboundedPreceding, -1)
    swept = events.withColumn("_e", F.explode(steps)).withColumn("waiting", F.coalesce(F.sum("_e.step").over(before), F.lit(0)))
    return swept.where("_e.kind = 0").drop("_e").withColumn("fits", F.col("waiting") < capacity)
