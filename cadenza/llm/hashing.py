"""Words of many texts and their 64-bit hashes, in numpy over whole Arrow columns.

A word is a maximal run of bytes other than ASCII white space. Hashes are those
of a polynomial in the bytes, from prefix sums, so that the hash of any stretch
costs one subtraction and two products.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (uint64 in and out)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (BASE, INVERSE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    return up[: n + 1], down[: n + 1]


class Bytes:
    """Prefix sums over some bytes; hashes of stretches of them."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes from each place that has as many."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, counts)``: where words lie in the bytes, and how many each text has."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    inside = ~SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    begins = inside.copy()
    begins[1:] &= SPACE[raw[:-1]] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= SPACE[raw[1:]] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))
