"""A cursor over bits, highest first, and parsing by tables of fields."""

from __future__ import annotations

from collections.abc import Collection, Sequence

#: A field: its name (None: skipped), its bits, the values allowed (None: any), and the status of any other value.
Field = tuple[str | None, int, Collection[int] | None, str]


class StreamError(ValueError):
    """What a stream can't be read for; ``status`` is ``corrupt`` or ``unsupported``."""

    def __init__(self, status: str, what: str):
        super().__init__(what)
        self.status = status


class BitCursor:
    def __init__(self, data: bytes, at: int = 0):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), at

    def read(self, bits: int) -> int:
        if self.at + bits > self.size:
            raise StreamError("corrupt", "a field ends behind its data")
        self.at += bits
        return (self.value >> (self.size - self.at)) & ((1 << bits) - 1)

    def signed(self, bits: int) -> int:
        v = self.read(bits)
        return v - (v >> (bits - 1) << bits)

    def zero(self, bits: int) -> None:
        if self.read(bits):
            raise StreamError("corrupt", "reserved bits are set")

    def align(self, unit: int) -> None:
        self.zero(-self.at % unit)

    def variable(self, group: int, most: int = 8190) -> int:
        """A number in groups of bits, each with a flag whether another follows, which counts on from the next power; five groups at most."""
        total = 0
        for _ in range(5):
            total += self.read(group)
            if total > most:
                break
            if not self.read(1):
                return total
            total = (total + 1) << group
        raise StreamError("corrupt", "a length without end")

    def fields(self, table: Sequence[Field]) -> dict[str, int]:
        found = {}
        for name, bits, allowed, status in table:
            v = self.read(bits)
            if allowed is not None and v not in allowed:
                raise StreamError(status, f"{name or 'reserved'} is {v}")
            if name:
                found[name] = v
        return found
