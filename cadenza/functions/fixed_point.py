"""Integer and level arithmetic of sample streams, as Column expressions.

All integers are BIGINT: under ANSI mode an overflow raises, so the one wanted
wrap is written out. Null in, null out; 0 is a value, never a stand-in for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: Column) -> Column:
    return x.cast("bigint")


def wrap32(x: Column) -> Column:
    """The signed 32-bit integer with the same low 32 bits."""
    return ((_long(x) + F.lit(2**31)).bitwiseAND(F.lit(2**32 - 1))) - F.lit(2**31)


def floor_shift(x: Column, n: int) -> Column:
    """Division by 2**n that rounds towards minus infinity."""
    return F.shiftright(_long(x), n)


def pcm24(x: Column) -> Column:
    """The signed 24-bit integer with the same low 24 bits."""
    low = _long(x).bitwiseAND(F.lit(2**24 - 1))
    return F.when(low >= F.lit(2**23), low - F.lit(2**24)).otherwise(low)


def clear_low_bits(x: Column, bits: int) -> Column:
    return _long(x).bitwiseAND(F.lit(~((1 << bits) - 1)))


def round_half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + F.lit(0.5))


def quantize24(x: Column) -> tuple[Column, Column]:
    """``(sample, clipped)``: full scale 1.0 as a 24-bit integer, and whether the value lay outside the range before it was rounded."""
    scaled, top, bottom = x * F.lit(float(2**23)), F.lit(float(2**23 - 1)), F.lit(float(-(2**23)))
    return round_half_away(F.greatest(bottom, F.least(top, scaled))).cast("bigint"), (scaled > top) | (scaled < bottom)


def _wide(x: Column) -> Column:
    """As a decimal; two multiplied and a third added take 38 digits at most."""
    return _long(x).cast("decimal(19,0)")


def _narrow(x: Column) -> Column:
    """The 64-bit integer, or null outside its range; compared beforehand, as ``try_`` functions throw inside at each overflow."""
    return F.when(x.between(F.lit(-(2**63)), F.lit(2**63 - 1)), x.cast("bigint"))


def checked_add(a: Column, b: Column) -> Column:
    """The sum, or null where it overflows 64 bits."""
    return _narrow(_wide(a) + _wide(b))


def checked_multiply(a: Column, b: Column) -> Column:
    """The product, or null where it overflows 64 bits."""
    return _narrow(_wide(a) * _wide(b))


def checked_multiply_add(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c``, or null where that overflows 64 bits; the product alone may."""
    return _narrow(_wide(a) * _wide(b) + _wide(c))


def coefficient(x: Column, shift: int) -> Column:
    """A coefficient scaled by 2**shift; null where that leaves 32 bits."""
    scaled = checked_multiply(x, F.lit(1 << shift))
    return F.when(scaled.between(F.lit(-(2**31)), F.lit(2**31 - 1)), scaled)


def db_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def checked_db_gain(db: Column, low: float = -120.0, high: float = 24.0) -> Column:
    """The gain of a level a user asked for; a level outside the range, or no number, raises."""
    bad = F.raise_error(F.concat(F.lit("a level outside the range: "), db.cast("string")))
    return F.when(db.isNull(), None).when(db.between(low, high) & ~F.isnan(db), db_gain(db)).otherwise(bad.cast("double"))


def dialogue_gain(code: Column) -> Column:
    """The linear gain that brings a dialogue level of ``-code`` dB to -31 dB."""
    return db_gain(code.cast("double") - F.lit(31.0))


def coordinate_x(code: Column) -> Column:
    """A 6-bit code as left (-1) to right (1); 62 and 63 are both 1."""
    return F.least(code, F.lit(62)).cast("double") / F.lit(31.0) - F.lit(1.0)


def coordinate_y(code: Column) -> Column:
    """A 6-bit code as front (1) to back (-1); 62 and 63 are both -1."""
    return -coordinate_x(code)


def coordinate_z(up: Column, code: Column) -> Column:
    """A 4-bit height with its direction: 1 for up, 0 for down."""
    return F.when(up == 1, F.lit(1.0)).when(up == 0, F.lit(-1.0)) * code.cast("double") / F.lit(15.0)


def timecode(samples: Column, rate: int = 48_000) -> Column:
    """Whole seconds as HH:MM:SS; hours take as many digits as they need."""
    s = F.floor(samples / F.lit(rate)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
