"""Headers, layer directories and position events of access units, as columns.

What a unit can't be parsed for is a status beside it (``ok``, ``corrupt``,
``unsupported``, ``need restart``), never an exception, unless ``strict``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.bits import BitCursor, Field, StreamError
from cadenza.functions.checksums import remainders

_U, _C = "unsupported", "corrupt"
#: The restart header's fields and the values of the supported profile.
HEADER: list[Field] = [
    ("signature", 32, {0xF8726FBA}, _C), ("rate", 4, {0}, _U), ("type", 4, {0}, _U), ("modifier_2", 2, {0}, _U), ("modifier_6", 2, {1}, _U), ("layout_6", 5, {0x0F}, _U), ("modifier_8", 2, {0}, _U),
    ("layout_8", 13, {0x04F}, _U), ("format", 16, {0xB752}, _C), ("flags", 16, {0, 0x1000}, _U), (None, 32, None, _C), ("layers", 4, {3, 4}, _U), (None, 2, {0}, _C), ("extended", 2, {0, 3}, _U), ("info", 8, {0x3C, 0x7C, 0xFC}, _U),
    (None, 17, None, _C), ("dialogue_0", 6, None, _C), (None, 6, None, _C), ("dialogue_1", 5, None, _C), (None, 11, None, _C), ("dialogue_2", 5, None, _C), (None, 14, None, _C),
]
#: The extension of a stream with elements.
EXTENSION: list[Field] = [("words", 4, {1}, _C), ("dialogue_3", 5, None, _C), (None, 6, None, _C), ("last_element", 5, {11, 13, 15}, _U), ("objects", 1, {1}, _U), ("bed", 1, {1}, _U), ("assignment", 10, {0}, _U)]
#: What stands before and in each element of a position event.
EVENT_HEAD: list[Field] = [("flags", 3, {0b110}, _U), ("list", 8, {0x11}, _U)]
ELEMENT: list[Field] = [("inactive", 1, {0}, _U), ("gain", 2, {0, 3}, _U), ("priority", 1, {1}, _U)]
ELEMENT_PLACE: list[Field] = [("x", 6, None, _C), ("y", 6, None, _C), ("up", 1, None, _C), ("z", 4, None, _C), ("rest", 9, {0b000010000}, _U)]
#: What stands before the length of an event in the wrapper around it, and behind its bytes.
WRAPPER: list[Field] = [
    ("version", 2, {0}, _U), ("key", 3, {0}, _U), ("kind", 5, {11}, _U), ("offset", 1, {0}, _U), ("duration", 1, {0}, _U), ("group", 1, {0}, _U), ("codec", 1, {1}, _U), ("codec_data", 8, {8}, _U),
    ("discard", 1, {0}, _U), ("aligned", 1, {1}, _U), ("create", 1, {0}, _U), ("remove", 1, {0}, _U), ("priority", 5, {0}, _U), ("level", 2, {0}, _U),
]
WRAPPER_TAIL: list[Field] = [("next", 5, {0}, _C), ("primary", 2, {1}, _U), ("secondary", 2, {0}, _U)]
#: The word that ends a layer, and what all protected bytes of a wrapper xor to.
END_WORD, WRAPPER_PARITY = 0xD234, 0xA9
OFFSETS, RAMPS = (8, 16, 18, 24), (0, 512, 1536)
LONG_RAMPS = (32, 64, 128, 256, 320, 480, 1000, 1001, 1024, 1600, 1601, 1602, 1920, 2000, 2002, 2048)

HEADER_SCHEMA = "status string, header_bytes int, layers int, elements int, dialogue array<int>"
DIRECTORY_SCHEMA = "status string, entries array<struct<layer int, begin int, end int, drc int>>, body int"
WRAPPER_SCHEMA = "status string, event binary, check int"
EVENT_SCHEMA = "status string, sample_offset int, ramp int, targets array<struct<x double, y double, z double>>"


def is_restart(payload: Column) -> Column:
    """Whether a unit begins with a restart header; a native predicate, so other units never reach Python."""
    return F.coalesce((F.octet_length(payload) >= 8) & (F.substring(payload, 5, 3) == F.lit(bytes.fromhex("f8726f"))), F.lit(False))


def size_status(payload: Column) -> Column:
    """``ok`` where a unit has 4 to 8190 bytes, evenly many, as its first word says."""
    n = F.octet_length(payload)
    said = F.conv(F.hex(F.substring(payload, 1, 2)), 16, 10).cast("int").bitwiseAND(F.lit(0xFFF)) * 2
    return F.when(payload.isNull() | (n < 4) | (n > 8190) | (n % 2 != 0) | (said != n), _C).otherwise("ok")


def parse_header(unit: bytes) -> dict:
    """The restart header of a unit's bytes from the fifth on."""
    data = unit[4:]
    try:
        if len(data) < 28:
            raise StreamError(_C, "a short header")
        extended = data[25] & 1
        words = data[26] >> 4 if extended and len(data) > 26 else 0
        size = 28 + (2 + 2 * words if extended else 0)
        if len(data) < size:
            raise StreamError(_C, "a short header")
        if int(remainders([data[: size - 2]], 0x2D, 16)[0]) != int.from_bytes(data[size - 2 : size], "big"):
            raise StreamError(_C, "a header's check differs")
        cursor = BitCursor(data[: size - 2])
        found = cursor.fields(HEADER)
        elements = found["layers"] == 4
        if (found["extended"] == 3, found["info"] == 0xFC, bool(extended), found["flags"] == 0x1000) != (elements,) * 4:
            raise StreamError(_U, "flags that don't fit the number of layers")
        levels = [found[f"dialogue_{k}"] for k in range(3)]
        if elements:
            more = cursor.fields(EXTENSION)
            levels.append(more["dialogue_3"])
            found |= more
        return {"status": "ok", "header_bytes": size, "layers": found["layers"], "elements": found["last_element"] + 1 if elements else 0, "dialogue": levels}
    except StreamError as e:
        return {"status": e.status, "header_bytes": None, "layers": None, "elements": None, "dialogue": None}


def parse_directory(unit: bytes, header_bytes: int | None, layers: int | None, restart: bool) -> dict:
    """Where each layer's bytes lie behind the directory, and its level word where it has one; header parity is checked."""
    try:
        if not layers:
            raise StreamError("need restart", "no restart header yet")
        at, end, entries = 4 + (header_bytes or 0 if restart else 0), 0, []
        parity = 0
        for b in unit[:4]:
            parity ^= b
        for layer in range(layers):
            word, drc = BitCursor(unit[at : at + 2]).read(16), None
            words = unit[at : at + (4 if word & 0x8000 else 2)]
            if word & 0x8000:
                cursor = BitCursor(words, 16)
                drc = cursor.signed(9)
                cursor.read(3)
                cursor.zero(4)
            at += 4 if word & 0x8000 else 2
            for b in words:
                parity ^= b
            begin, end = end, 2 * (word & 0xFFF)
            if end <= begin:
                raise StreamError(_C, "layers out of order")
            if not word & 0x2000:
                raise StreamError(_U, "a layer without checks")
            if bool(word & 0x4000) == restart:
                raise StreamError(_C, "a restart flag that doesn't fit")
            entries.append({"layer": layer, "begin": begin, "end": end, "drc": drc})
        if (parity >> 4) ^ (parity & 15) != 15:
            raise StreamError(_C, "a header's parity differs")
        if at + end > len(unit):
            raise StreamError(_C, "a layer ends behind the unit")
        return {"status": "ok", "entries": entries, "body": at}
    except StreamError as e:
        return {"status": e.status, "entries": None, "body": None}


def parse_event(payload: bytes, elements: int) -> dict:
    """A position event: samples until it begins, its ramp, and a place for every element; the first is the low-frequency one."""
    try:
        cursor = BitCursor(payload)
        cursor.fields([("version", 2, {0}, _U), ("last", 5, {elements - 1}, _C), *EVENT_HEAD])
        size = cursor.variable(4) + 1
        end = cursor.at + 8 * size
        cursor.fields([("dropped", 1, {0}, _U)])
        mode = cursor.fields([("mode", 2, {0, 1, 2}, _U)])["mode"]
        offset = OFFSETS[cursor.read(2)] if mode == 1 else cursor.read(5) if mode == 2 else 0
        cursor.fields([("blocks", 3, {0}, _U)])
        offset += 32 * cursor.read(6)
        kind = cursor.read(2)
        ramp = RAMPS[kind] if kind < 3 else LONG_RAMPS[cursor.read(4)] if cursor.read(1) else cursor.read(11)
        cursor.fields([("data", 1, {1}, _U)])
        targets = []
        for k in range(elements):
            cursor.fields(ELEMENT)
            place = {"x": 31, "y": 0, "up": 0, "z": 15} if k == 0 else cursor.fields(ELEMENT_PLACE)
            x, y = (min(place[c], 62) / 31 - 1 for c in "xy")
            targets.append({"x": x, "y": -y, "z": (1 if place["up"] else -1) * place["z"] / 15})
            cursor.fields([("more", 1, {0}, _U)])
        if cursor.at > end:
            raise StreamError(_C, "an event longer than it says")
        cursor.zero(end - cursor.at)
        cursor.zero(cursor.size - cursor.at)
        return {"status": "ok", "sample_offset": offset, "ramp": ramp, "targets": targets}
    except StreamError as e:
        return {"status": e.status, "sample_offset": None, "ramp": None, "targets": None}


def parse_wrapper(data: bytes) -> dict:
    """The event's bytes in the wrapper behind a unit's layers, and the wrapper's keyed check byte, which is not evaluated here."""
    try:
        if len(data) < 6 or len(data) % 2:
            raise StreamError(_C, "a truncated wrapper")
        head, parity = data[0] ^ data[1], 0
        for b in data[2:]:
            parity ^= b
        if (head >> 4) ^ (head & 15) != 15 or parity != WRAPPER_PARITY:
            raise StreamError(_C, "a wrapper's parity differs")
        size = int.from_bytes(data[2:4], "big") & 0xFFF
        if 2 * (int.from_bytes(data[:2], "big") & 0xFFF) + 2 != len(data) or not 0 < size < len(data) - 4:
            raise StreamError(_C, "a wrapper's length differs")
        if any(data[4 + size : -1]):
            raise StreamError(_C, "padding that isn't 0")
        cursor = BitCursor(data[4 : 4 + size])
        cursor.fields(WRAPPER)
        n = cursor.variable(8)
        if not n or 8 * n > cursor.size - cursor.at:
            raise StreamError(_C, "an event longer than its wrapper")
        event = cursor.read(8 * n).to_bytes(n, "big")
        cursor.fields(WRAPPER_TAIL)
        check = cursor.read(8)
        cursor.zero(cursor.size - cursor.at)
        return {"status": "ok", "event": event, "check": check}
    except StreamError as e:
        return {"status": e.status, "event": None, "check": None}


def wrappers(units: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows of directories() with ``wrapper``: null where a unit has nothing behind its layers or no directory."""

    @F.pandas_udf(WRAPPER_SCHEMA)
    def parsed(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_wrapper(bytes(v)) if v is not None else dict.fromkeys(("status", "event", "check")) for v in x], columns=["status", "event", "check"])

    begin = F.col("directory.body") + F.array_max(F.transform("directory.entries", lambda e: e["end"]))
    rest = F.substring(F.col(payload), begin + 1, F.octet_length(payload) - begin)
    return units.withColumn("wrapper", F.when(F.octet_length(rest) > 0, parsed(rest)))


def end_of_layer(tail: Column) -> Column:
    """``status, ended, trim`` of the bytes behind a layer's last block: whether the stream ends here, and how many samples its last unit lacks.

    Nothing there: the stream goes on. Else the end word and either a second
    one or a count below 40 with its three highest bits set. Null for null.
    """
    n = F.octet_length(tail)
    word = lambda at: F.conv(F.hex(F.substring(tail, at, 2)), 16, 10).cast("int")
    count = word(3).bitwiseAND(F.lit(0x1FFF))
    trims = (word(3) >= 0xE000) & (count < 40)
    shown = lambda status, ended, trim: F.struct(F.lit(status).alias("status"), F.lit(ended).alias("ended"), trim.alias("trim"))
    marked = (n == 4) & (word(1) == END_WORD)
    return F.when(n == 0, shown("ok", False, F.lit(0))).when(marked & trims, shown("ok", True, count)).when(marked & (word(3) == END_WORD), shown("ok", True, F.lit(0))).when(n.isNotNull(), shown(_C, False, F.lit(None).cast("int")))


def trimmed(samples: Column, trim: Column) -> Column:
    """An array of samples without its last ``trim``; a null trim takes none."""
    return F.slice(samples, F.lit(1), F.greatest(F.lit(0), F.size(samples) - F.coalesce(trim, F.lit(0))))


def headers(units: DataFrame, key: str, order: str, payload: str = "payload") -> DataFrame:
    """``units`` with ``restart, interval_id`` and the ``header`` that holds at each: parsed at restarts alone, held until the next."""

    @F.pandas_udf(HEADER_SCHEMA)
    def parsed(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_header(bytes(v)) for v in x], columns=["status", "header_bytes", "layers", "elements", "dialogue"])

    marked = units.withColumn("restart", is_restart(F.col(payload)))
    known = marked.where("restart").select(key, order, parsed(F.col(payload)).alias("_header"))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.join(known, [key, order], "left")
    return joined.withColumn("interval_id", F.sum(F.col("restart").cast("bigint")).over(w)).withColumn("header", F.last("_header", ignorenulls=True).over(w)).drop("_header")


def directories(units: DataFrame, payload: str = "payload", strict: bool = False) -> DataFrame:
    """The rows of headers() with ``directory``; in a strict run a unit that can't be parsed raises."""

    @F.pandas_udf(DIRECTORY_SCHEMA)
    def parsed(x: pd.Series, size: pd.Series, layers: pd.Series, restart: pd.Series) -> pd.DataFrame:
        whole = lambda v: None if pd.isna(v) else int(v)
        out = [parse_directory(bytes(v), whole(a), whole(b), bool(r)) for v, a, b, r in zip(x, size, layers, restart, strict=True)]
        if strict and any(r["status"] != "ok" for r in out):
            raise ValueError(next(r["status"] for r in out if r["status"] != "ok"))
        return pd.DataFrame(out, columns=["status", "entries", "body"])

    return units.withColumn("directory", parsed(F.col(payload), F.col("header.header_bytes"), F.col("header.layers"), F.col("restart")))


def layers(units: DataFrame, key: str, order: str) -> DataFrame:
    """``key, order, layer, begin, end, drc`` of every layer; a level word holds until the layer's next one."""
    entries = units.select(key, order, F.explode("directory.entries").alias("e")).select(key, order, "e.*")
    w = Window.partitionBy(key, "layer").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("drc", F.last("drc", ignorenulls=True).over(w))

