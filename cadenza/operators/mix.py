"""Speaker layouts, folds between them, panning gains and rendering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.names import named

#: Speakers in the order of their numbers.
SPEAKERS = ("FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR", "TFL", "TFR", "TBL", "TBR", "TML", "TMR", "FWL", "FWR")
#: Speaker bits of the public WAVEFORMATEXTENSIBLE channel mask; the other speakers have none.
MASK = {"FL": 0x1, "FR": 0x2, "FC": 0x4, "LFE": 0x8, "BL": 0x10, "BR": 0x20, "SL": 0x200, "SR": 0x400, "TFL": 0x1000, "TFR": 0x4000, "TBL": 0x8000, "TBR": 0x20000}
#: The named layouts' speakers in slot order.
LAYOUTS = {
    name: tuple(speakers.split())
    for name, speakers in {
        "2.0": "FL FR",
        "5.1": "FL FR FC LFE SL SR",
        "5.1(back)": "FL FR FC LFE BL BR",
        "5.1.2": "FL FR FC LFE SL SR TML TMR",
        "5.1.2(back)": "FL FR FC LFE BL BR TML TMR",
        "5.1.4": "FL FR FC LFE SL SR TFL TFR TBL TBR",
        "5.1.4(back)": "FL FR FC LFE BL BR TFL TFR TBL TBR",
        "7.1": "FL FR FC LFE BL BR SL SR",
        "7.1.2": "FL FR FC LFE BL BR SL SR TML TMR",
        "7.1.4": "FL FR FC LFE BL BR SL SR TFL TFR TBL TBR",
        "7.1.6": "FL FR FC LFE BL BR SL SR TFL TFR TBL TBR TML TMR",
        "9.1.6": "FL FR FC LFE BL BR SL SR TFL TFR TBL TBR TML TMR FWL FWR",
    }.items()
}
#: Room coordinates (x right, y front, z up); BL and BR stand at the sides where they are the only surrounds.
PLACES = {
    "FL": (-1, 1, 0), "FC": (0, 1, 0), "FR": (1, 1, 0), "FWL": (-1, 0.5, 0), "FWR": (1, 0.5, 0), "SL": (-1, 0, 0), "SR": (1, 0, 0), "BL": (-1, -1, 0), "BR": (1, -1, 0),
    "TFL": (-1, 1, 1), "TFR": (1, 1, 1), "TML": (-1, 0, 1), "TMR": (1, 0, 1), "TBL": (-1, -1, 1), "TBR": (1, -1, 1),
}
#: The order in which speakers are displayed.
DISPLAY = ("FL", "FR", "FC", "LFE", "SL", "SR", "BL", "BR", "FWL", "FWR", "TFL", "TFR", "TML", "TMR", "TBL", "TBR")
#: The bed's channels, and where they stand.
BED = LAYOUTS["7.1"]
HALF_POWER = math.sqrt(0.5)
HALF_PI = math.pi / 2

#: What takes up a left or middle speaker that a layout lacks: the first entry of which the layout has every speaker.
_LEFT_FOLDS = {
    "FC": [{"FL": HALF_POWER, "FR": HALF_POWER}],
    "FWL": [{"FL": HALF_POWER}],
    "SL": [{"BL": HALF_POWER}, {"FL": HALF_POWER}],
    "BL": [{"SL": HALF_POWER}, {"FL": HALF_POWER}],
    "TFL": [{"TML": 1.0}, {"FL": HALF_POWER}],
    "TBL": [{"TML": 1.0}, {"BL": HALF_POWER}, {"SL": HALF_POWER}, {"FL": HALF_POWER}],
    "TML": [{"TFL": HALF_POWER, "TBL": HALF_POWER}, {"TFL": 1.0}, {"SL": HALF_POWER}, {"BL": HALF_POWER}, {"FL": HALF_POWER}],
}


def _mirrored(name: str) -> str:
    return name[:-1] + "R" if name.endswith("L") else name


FOLDS = _LEFT_FOLDS | {_mirrored(s): [{_mirrored(t): g for t, g in way.items()} for way in ways] for s, ways in _LEFT_FOLDS.items() if s != "FC"}


def fold_table(source: str, target: str) -> list[tuple[int, int, float]]:
    """``(source slot, target slot, gain)``; a speaker that nothing takes up (LFE) is left out."""
    there, out = LAYOUTS[target], []
    for i, name in enumerate(LAYOUTS[source]):
        ways = [{name: 1.0}, *FOLDS.get(name, [])]
        chosen = next((way for way in ways if all(s in there for s in way)), {})
        out += [(i, there.index(s), g) for s, g in chosen.items()]
    return out


def bed_table(target: str) -> list[tuple[int, int, float]]:
    """``(bed channel, target slot, gain)`` for a bed of eight channels in a layout of two, six or eight floor speakers.

    Stereo takes centre and surrounds, and a single pair of surrounds both
    pairs, at half power; heights stay silent.
    """
    there = LAYOUTS[target]
    floor = [s for s in there if SPEAKERS.index(s) <= SPEAKERS.index("SR")]
    if len(floor) == 2:
        sides = {"FL": ("FC", "BL", "SL"), "FR": ("FC", "BR", "SR")}
    elif len(floor) == 6:
        sides = {s: (f"B{s[-1]}", f"S{s[-1]}") for s in floor if s[0] in "BS"}
    else:
        sides = {}
    out = []
    for slot, s in enumerate(there):
        if s in floor and not (len(floor) == 6 and s in sides):
            out.append((BED.index(s), slot, 1.0))
        out += [(BED.index(x), slot, HALF_POWER) for x in sides.get(s, ())]
    return out


def mix(df: DataFrame, key: str, samples: str, gains: list[tuple[int, int, float]], width: int) -> DataFrame:
    """``key, slot, value``: each output slot's weighted sum of an array's elements; missing elements are silence.

    The gain table is part of the expression: no join, no shuffle.
    """
    at = lambda i: F.coalesce(F.get(F.col(samples), F.lit(i)).cast("double"), F.lit(0.0))
    sums = []
    for slot in range(width):
        own = [at(i) * F.lit(g) for i, j, g in gains if j == slot]
        total = own[0] if own else F.lit(0.0)
        for x in own[1:]:
            total = total + x
        sums.append(total)
    return df.select(key, F.posexplode(F.array(*sums)).alias("slot", "value"))


def sequential_rows(state: Column, rows: Sequence[tuple[int, Sequence[int]]], shift: int) -> Column:
    """An array after matrix rows ``(output, coefficients)``, each of which sees what the rows before have put out."""
    for out, taps in rows:
        total = F.lit(0).cast("bigint")
        for i, c in enumerate(taps):
            if c:
                total = total + F.get(state, F.lit(i)).cast("bigint") * F.lit(c)
        state = _with_element(state, out, F.shiftright(total, shift))
    return state


def _with_element(array: Column, at: int, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == at, value).otherwise(x.cast("bigint")))


def pair_gains(x: Column) -> tuple[Column, Column]:
    """Equal-power gains of the left and right of two speakers for a position of -1..1; beyond, the nearer one."""
    angle = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + F.lit(1.0)) * F.lit(math.pi / 4)
    return F.cos(angle), F.sin(angle)


def _share(x: Column, knots: Sequence[float], k: int) -> Column:
    """The equal-power weight of knot ``k`` for ``x``: 1 at the knot, 0 at its neighbours, 1 beyond an end knot."""
    out = F.when(x == knots[k], 1.0)
    if k == 0:
        out = out.when(x < knots[0], 1.0)
    else:
        out = out.when((x > knots[k - 1]) & (x < knots[k]), F.sin((x - knots[k - 1]) * (HALF_PI / (knots[k] - knots[k - 1]))))
    if k == len(knots) - 1:
        out = out.when(x > knots[-1], 1.0)
    else:
        out = out.when((x > knots[k]) & (x < knots[k + 1]), F.cos((x - knots[k]) * (HALF_PI / (knots[k + 1] - knots[k]))))
    return out.otherwise(F.when(x.isNotNull(), 0.0))


def _places(layout: str) -> dict[str, tuple]:
    speakers = LAYOUTS[layout]
    single = "BL" in speakers and "SL" not in speakers
    return {s: (PLACES[s][0], 0 if single and s[0] == "B" else PLACES[s][1], PLACES[s][2]) for s in speakers if s != "LFE"}


def speaker_gains(layout: str, x: Column, y: Column, z: Column, is_lfe: Column) -> list[Column]:
    """The gain of every slot of a layout for an element at ``(x, y, z)``; null where the position is.

    Power is shared between the two nearest rows of speakers from front to
    back, in each between the two nearest from left to right, and between floor
    and top by height (0..1; below the floor counts as floor). A layout without
    a top row has all on the floor. A low-frequency element goes to LFE alone.
    The layout is part of the expression: no join, no shuffle.
    """
    places = _places(layout)
    tops = any(p[2] for p in places.values())
    height = F.when(z.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)) * F.lit(HALF_PI))
    plane = {0: F.cos(height) if tops else F.when(z.isNotNull(), 1.0), 1: F.sin(height)}
    out = []
    for s in LAYOUTS[layout]:
        if s == "LFE":
            out.append(F.when(is_lfe, 1.0).otherwise(0.0))
            continue
        own = places[s]
        rows = sorted({p[1] for p in places.values() if p[2] == own[2]})
        columns = sorted(p[0] for p in places.values() if p[1:] == own[1:])
        gain = plane[own[2]] * _share(y, rows, rows.index(own[1])) * _share(x, columns, columns.index(own[0]))
        out.append(F.when(is_lfe, 0.0).otherwise(gain))
    return out


def render(elements: DataFrame, key: Sequence[str], layout: str, value: str = "value", x: str = "x", y: str = "y", z: str = "z", is_lfe: str = "is_lfe", gain: float = 1.0) -> DataFrame:
    """``key, slot, value, available``: each slot's sum over a sample's elements, wherever they stand at that sample.

    Nothing is clipped. Where the position of any element (but a low-frequency
    one) is unknown, the sample's slots are silent and not ``available``.
    """
    gains = speaker_gains(layout, F.col(x), F.col(y), F.col(z), F.col(is_lfe))
    known = F.bool_and(F.coalesce(F.col(is_lfe), F.lit(False)) | (F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()))
    sums = [F.sum(F.col(value) * g).alias(f"_slot{k}") for k, g in enumerate(gains)]
    summed = elements.groupBy(*key).agg(known.alias("available"), *sums)
    slots = F.array(*(F.when(F.col("available"), F.coalesce(F.col(f"_slot{k}"), F.lit(0.0)) * F.lit(gain)).otherwise(0.0) for k in range(len(gains))))
    return summed.select(*key, F.posexplode(slots).alias("slot", "value"), "available")


def presentation(df: DataFrame, samples: str, first: int, count: int, name: str = "view") -> DataFrame:
    """The input with ``count`` channels of an array from ``first`` on (a bed, or its objects)."""
    return df.withColumn(name, F.slice(F.col(samples), first + 1, count))


def solo(df: DataFrame, slot: Column | str, layout: str, speaker: str) -> DataFrame:
    """The rows of one speaker of a layout; none where the layout lacks it."""
    column = F.col(slot) if isinstance(slot, str) else slot
    return df.where(column == LAYOUTS[layout].index(speaker)) if speaker in LAYOUTS[layout] else df.limit(0)


def layout_table(spark: SparkSession) -> DataFrame:
    """``layout, slot, speaker, bit`` of all layouts (bounded by LAYOUTS); bit 0 for speakers without one."""
    rows = [(name, slot, s, MASK.get(s, 0)) for name, speakers in LAYOUTS.items() for slot, s in enumerate(speakers)]
    return spark.createDataFrame(rows, "layout string, slot int, speaker string, bit bigint")


def speaker_name(code: Column) -> Column:
    """The label of a speaker's number; ``unknown`` for a number without one."""
    return named(code, SPEAKERS, "unknown")


def is_layout(speakers: Sequence[str]) -> bool:
    """Whether some speakers, in any order but each once, are those of a named layout."""
    return len(set(speakers)) == len(speakers) and any(set(speakers) == set(x) for x in LAYOUTS.values())


def display_order(speakers: Sequence[str]) -> list[str]:
    return sorted(speakers, key=DISPLAY.index)


def is_permutation(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same speakers, each once."""
    return (F.size(F.array_distinct(a)) == F.size(a)) & (F.array_sort(a) == F.array_sort(b))


def channel_masks(layouts: DataFrame) -> DataFrame:
    """``layout, mask``: all speakers' bits; 0 where one has none or slots aren't in the order of their bits."""
    listed = layouts.groupBy("layout").agg(F.array_sort(F.collect_list(F.struct("slot", "bit"))).alias("s"))
    bits = F.transform("s", lambda x: x["bit"])
    fits = (bits == F.array_sort(F.array_distinct(bits))) & (F.array_min(bits) > 0)
    return listed.select("layout", F.when(fits, F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))).otherwise(F.lit(0)).alias("mask"))


def mask_speakers(mask: Column) -> Column:
    """The speakers of a channel mask in the order of their bits; null where it holds a bit without a speaker."""
    names = F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(s)) for s, bit in sorted(MASK.items(), key=lambda x: x[1]))), lambda x: x.isNotNull())
    return F.when(mask.bitwiseAND(F.lit(~sum(MASK.values()))) == 0, names)
