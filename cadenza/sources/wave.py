"""Bytes of 24-bit PCM in RIFF/WAVE files (public RIFF and WAVEFORMATEXTENSIBLE layouts); see pcm.py for files of rows and RF64."""

from __future__ import annotations

import struct

import numpy as np

_GUID = bytes.fromhex("0100000000001000800000aa00389b71")
_EXTENSIBLE = 0xFFFE


def header(channels: int, mask: int, frames: int, rate: int = 48_000) -> bytes:
    """Header of a file of signed 24-bit frames; raises ValueError beyond 4 GiB."""
    size = frames * channels * 3
    form = struct.pack("<HHIIHHHHI16s", _EXTENSIBLE, channels, rate, rate * channels * 3, channels * 3, 24, 22, 24, mask, _GUID)
    total = 4 + 8 + len(form) + 8 + size + size % 2
    if total > 0xFFFFFFFF:
        raise ValueError("more than a RIFF file holds")
    return b"RIFF" + struct.pack("<I", total) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", size)


def pack24(samples: np.ndarray) -> bytes:
    """Integers of -2**23..2**23-1 as little-endian 24-bit."""
    return samples.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()


def unpack24(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
    value = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
    return np.where(value >= 1 << 23, value - (1 << 24), value).astype(np.int32)


def read(data: bytes) -> tuple[int, int, np.ndarray]:
    """``(rate, channel mask, frames x channels)`` of a file that header() began."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHHHHI16s", data, at + 8)
        elif name == b"data" and form:
            return form[2], form[8], unpack24(data[at + 8 : at + 8 + size]).reshape(-1, form[1])
        at += 8 + size + size % 2
    raise ValueError("no samples")
