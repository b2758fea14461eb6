"""Access units from a stream of byte fragments, with state kept from one micro-batch to the next.

A stream's state is the bytes that make no whole unit yet, the number of its
next fragment, unit and byte, and whether it has ended or failed. It is
committed with the micro-batch, so a retried batch neither loses nor repeats a
unit. Batch and stream use one function, and give the same rows however the
bytes are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UNIT_SCHEMA = "stream_id string, au bigint, byte_offset bigint, n_bytes int, payload binary, status string"
STATE_SCHEMA = "fragment bigint, rest binary, au bigint, byte_offset bigint, closed boolean"
FRESH = (0, b"", 0, 0, False)
_COLUMNS = ["stream_id", "au", "byte_offset", "n_bytes", "payload", "status"]


def feed(stream_id: str, state: tuple, fragments: list[tuple[int, bytes, bool]], strict: bool = False) -> tuple[tuple, list[tuple]]:
    """State and units after ``(number, bytes, is the last)`` fragments.

    A fragment met before is passed over. A gap, a unit of no valid size, bytes
    after the end and a truncated tail give one last row with their status, and
    close the stream; in a strict run they raise, and the state stays as it was.
    """
    number, rest, au, at, closed = state
    rest, out = bytearray(rest), []

    def fail(status: str) -> None:
        nonlocal closed
        if strict:
            raise ValueError(f"{stream_id}: {status} at byte {at}")
        shown = bytes(rest[:2] if status == "corrupt" else rest)
        out.append((stream_id, au, at, len(shown), shown, status))
        closed = True
        rest.clear()

    for own, data, final in sorted(fragments, key=lambda x: x[0]):
        if own < number:
            continue
        if closed:
            if data and strict:
                raise ValueError(f"{stream_id}: data after the end")
            continue
        if own > number:
            fail("gap")
            continue
        number += 1
        rest += data or b""
        used = 0
        while len(rest) - used >= 2:
            size = 2 * (int.from_bytes(rest[used : used + 2], "big") & 0xFFF)
            if size < 4:
                break
            if used + size > len(rest):
                break
            out.append((stream_id, au, at, size, bytes(rest[used : used + size]), "ok"))
            used, au, at = used + size, au + 1, at + size
        del rest[:used]
        if len(rest) >= 2 and 2 * (int.from_bytes(rest[:2], "big") & 0xFFF) < 4:
            fail("corrupt")
        elif final:
            if rest:
                fail("truncated")
            closed = True
    return (number, bytes(rest), au, at, closed), out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def stream_units(fragments: DataFrame, strict: bool = False) -> DataFrame:
    """Units of a streaming DataFrame of ``stream_id, fragment, data, final``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else FRESH
        met = [(int(n), bytes(d) if d is not None else b"", bool(f)) for b in batches for n, d, f in zip(b["fragment"], b["data"], b["final"], strict=True)]
        after, out = feed(key[0], now, met, strict)
        state.update(after)
        yield _frame(out)

    own = fragments.select("stream_id", "fragment", "data", "final")
    return own.groupBy("stream_id").applyInPandasWithState(step, UNIT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def batch_units(fragments: DataFrame, strict: bool = False) -> DataFrame:
    """The same units of a batch DataFrame; a stream's fragments stream by in order."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, FRESH
        for batch in batches:
            out = []
            for name, own in batch.groupby("stream_id", sort=False):
                if name != last:
                    last, state = name, FRESH
                met = [(int(n), bytes(d) if d is not None else b"", bool(f)) for n, d, f in zip(own["fragment"], own["data"], own["final"], strict=True)]
                state, rows = feed(name, state, met, strict)
                out += rows
            yield _frame(out)

    own = fragments.select("stream_id", "fragment", "data", "final").where("stream_id is not null")
    return own.repartition("stream_id").sortWithinPartitions("stream_id", "fragment").mapInPandas(fold, UNIT_SCHEMA)
