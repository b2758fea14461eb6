"""Names of codes, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of statuses in the order of their codes.
STATUSES = (
    "ok", "invalid argument", "corrupt stream", "unsupported stream profile", "restart required", "buffer too small", "device unavailable",
    "unknown speaker layout", "out of memory", "unsupported audio output", "native audio failure", "audio timeout", "cancelled",
)
#: Names of output backends in the order of their codes.
BACKENDS = ("unavailable", "CoreAudio", "WASAPI", "Windows Spatial Audio", "PipeWire", "ALSA")


def named(code: Column, names: Sequence[str], other: str) -> Column:
    """The name of a code from 0 on; ``other`` for a code without one, null for null."""
    known = code.between(F.lit(0), F.lit(len(names) - 1))
    return F.when(known, F.get(F.array(*map(F.lit, names)), F.when(known, code).cast("int"))).when(code.isNotNull(), F.lit(other))


def status_name(code: Column) -> Column:
    return named(code, STATUSES, "unknown status")


def backend_name(code: Column) -> Column:
    return named(code, BACKENDS, "unknown")
