"""A report of levels over decoded samples, with its options checked before anything is read."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import fixed_point as fx
from cadenza.operators import mix


@dataclass(frozen=True)
class Options:
    """``layer``: one presentation as it is; or ``layout`` with an ``order`` of its speakers, a gain, and one speaker alone.

    ``start``, ``limit``: the first sample, and how many. Options that exclude
    one another raise ValueError.
    """

    layer: int | None = None
    layout: str | None = None
    order: Sequence[str] = ()
    gain_db: float = 0.0
    solo: str | None = None
    start: int = 0
    limit: int | None = None

    def __post_init__(self) -> None:
        if (self.layer is None) == (self.layout is None):
            raise ValueError("either a layer or a layout")
        if self.layer is not None and (self.layer not in range(4) or self.order or self.gain_db or self.solo):
            raise ValueError("a layer (0 to 3) is reported as it is")
        if self.layout is not None and self.layout not in mix.LAYOUTS:
            raise ValueError(f"no layout {self.layout}")
        if self.order and sorted(self.order) != sorted(mix.LAYOUTS[self.layout]):
            raise ValueError("an order names each speaker of the layout once")
        if self.solo and self.solo not in mix.LAYOUTS[self.layout]:
            raise ValueError(f"{self.layout} has no {self.solo}")
        if not math.isfinite(self.gain_db) or not -120 <= self.gain_db <= 24:
            raise ValueError("a gain lies between -120 and 24 dB")
        if self.start < 0 or (self.limit is not None and self.limit < 0):
            raise ValueError("a start and a limit are not negative")


def report(samples: DataFrame, options: Options, layer: str = "layer", sample: str = "sample", slot: str = "slot", value: str = "value") -> DataFrame:
    """``slot, n, peak, rms, clips`` of 24-bit samples made from values of full scale 1.0; nulls aren't counted.

    With an ``order``, ``slot`` is a speaker's place there. One aggregation;
    the selections reach the scan.
    """
    own = samples.where(F.col(sample) >= options.start)
    if options.limit is not None:
        own = own.where(F.col(sample) < options.start + options.limit)
    if options.layer is not None:
        own = own.where(F.col(layer) == options.layer)
    if options.solo:
        own = mix.solo(own, slot, options.layout, options.solo)
    place = F.col(slot)
    if options.order:
        place = F.get(F.array(*(F.lit(options.order.index(s)) for s in mix.LAYOUTS[options.layout])), place.cast("int"))
    quantized, clipped = fx.quantize24(F.col(value) * F.lit(10 ** (options.gain_db / 20)))
    made = own.where(F.col(value).isNotNull()).select(place.alias("slot"), quantized.alias("v"), clipped.alias("clipped"))
    level = F.col("v") / F.lit(float(2**23))
    return made.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(level * level)).alias("rms"), F.count_if("clipped").alias("clips"))
