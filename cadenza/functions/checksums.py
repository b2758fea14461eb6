"""Cyclic, parity and keyed checks of byte strings.

A cyclic check is the remainder of the bits, read as a polynomial over GF(2),
highest first, divided by ``x**width + polynomial``. A field that carries its
own check byte or bytes at the end leaves the remainder 0 or a known one.
Remainders are taken for a whole Arrow batch at once: messages are set flush
right, as leading zeros change no remainder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a batch's matrix that are handled at once.
MATRIX_BYTES = 4_000_000


def _table(polynomial: int, width: int) -> np.ndarray:
    """What 256 values of a byte add when they are shifted out of the register."""
    v = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        v = np.where(v >> (width - 1) & 1, (v << 1 ^ polynomial) & ((1 << width) - 1), v << 1)
    return v


def remainders(messages: list[bytes], polynomial: int, width: int, start: int = 0) -> np.ndarray:
    """Of each message, its first byte xor ``start``; width 8 or 16."""
    table, out = _table(polynomial, width), np.zeros(len(messages), np.int64)
    order = np.argsort([len(m) for m in messages], kind="stable")
    a = 0
    while a < len(order):
        b, widest = a, 1
        while b < len(order) and (b - a + 1) * max(1, len(messages[order[b]])) <= max(MATRIX_BYTES, len(messages[order[a]])):
            widest, b = max(1, len(messages[order[b]])), b + 1
        b = max(b, a + 1)
        widest = max(1, len(messages[order[b - 1]]))
        own = np.zeros((b - a, widest), np.int64)
        for k, i in enumerate(order[a:b]):
            data = np.frombuffer(messages[i], np.uint8)
            own[k, widest - len(data) :] = data
            if len(data):
                own[k, widest - len(data)] ^= start
        v = np.zeros(b - a, np.int64)
        for column in own.T:
            v = table[v >> (width - 8)] ^ ((v << 8) & ((1 << width) - 1)) ^ column
        out[order[a:b]] = v
        a = b
    return out


def cyclic(data: Column, polynomial: int, width: int, start: int = 0) -> Column:
    """The remainder of a binary column; null in, null out; 0 for no bytes."""

    @F.pandas_udf("bigint")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series(remainders([bytes(v) if v is not None else b"" for v in x], polynomial, width, start))

    return F.when(data.isNotNull(), f(data))


def bit_remainder(data: bytes, first_bit: int, bits: int, polynomial: int, width: int) -> int:
    """The remainder of ``bits`` bits from ``first_bit`` on."""
    value = (int.from_bytes(data, "big") >> (8 * len(data) - first_bit - bits)) & ((1 << bits) - 1)
    whole = (1 << width) | polynomial
    for k in range(max(bits, width) - 1, width - 1, -1):
        if value >> k & 1:
            value ^= whole << (k - width)
    return value


def byte_parity(data: Column) -> Column:
    """All bytes of a binary column xored; 0 for none, null for null."""

    @F.pandas_udf("int")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series([int(np.bitwise_xor.reduce(np.frombuffer(v, np.uint8))) if v else 0 for v in x])

    return F.when(data.isNotNull(), f(data))


def nibble_parity(x: Column) -> Column:
    """The four nibbles of a 16-bit integer xored."""
    x = x.cast("bigint")
    x = x.bitwiseXOR(F.shiftright(x, 8))
    return x.bitwiseXOR(F.shiftright(x, 4)).bitwiseAND(F.lit(15))


def hmac_sha256(data: Column, key: bytes) -> Column:
    """The keyed hash (RFC 2104) of a binary column in lowercase hex, in built-in functions; the key is the caller's."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)


def keyed_verdict(data: Column, expected: Column, key: bytes | None) -> Column:
    """``ok``, ``mismatch``, or ``not evaluated`` where no key is given."""
    if key is None:
        return F.lit("not evaluated")
    return F.when(hmac_sha256(data, key) == F.lower(expected), "ok").otherwise("mismatch")
