"""Files of PCM: RIFF/RF64 WAVE and raw samples, written exclusively and committed by rename, with a channel list beside them."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.mix import LAYOUTS
from cadenza.sources import wave

#: Bytes a sample of each raw format, and how 24-bit integers are laid out in it.
FORMATS = {
    "s24le": (3, wave.pack24),
    "s32le": (4, lambda x: (x.astype(np.int64) << 8).astype("<i4").tobytes()),
    "f32le": (4, lambda x: (x / 2.0**23).astype("<f4").tobytes()),
}


def header(channels: int, mask: int, frames: int, rate: int = 48_000) -> bytes:
    """A WAVE header of 24-bit frames: RF64 with 64-bit sizes where a RIFF file can't hold them, else with room for them."""
    size = frames * channels * 3
    form = struct.pack("<HHIIHHHHI16s", 0xFFFE, channels, rate, rate * channels * 3, channels * 3, 24, 22, 24, mask, bytes.fromhex("0100000000001000800000aa00389b71"))
    total = 4 + 8 + 28 + 8 + len(form) + 8 + size + size % 2
    big = total > 0xFFFFFFFF
    sizes = struct.pack("<QQQI", total, size, frames, 0) if big else bytes(28)
    return (b"RF64" if big else b"RIFF") + struct.pack("<I", 0xFFFFFFFF if big else total) + b"WAVE" + (b"ds64" if big else b"JUNK") + struct.pack("<I", 28) + sizes + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", 0xFFFFFFFF if big else size)


def channel_list(layout: str, rate: int = 48_000) -> str:
    """The JSON that stands beside a file: rate, bits and the speaker of each channel."""
    return json.dumps({"sampleRate": rate, "validBits": 24, "drcApplied": False, "channels": [{"index": k, "speaker": s} for k, s in enumerate(LAYOUTS[layout])]}, indent=2)


def write_pcm(blocks: DataFrame, out_dir: str, layout: str, mask: int = 0, file_format: str = "wave", file_col: str = "file", order_col: str = "first_sample", samples_col: str = "samples") -> DataFrame:
    """Write each file's blocks, in order, to ``out_dir``; returns ``file, frames, bytes``.

    ``samples`` is an array of interleaved 24-bit integers. A file is written
    by one task under a temporary name, block by block, and renamed when it is
    whole, so a lost task leaves nothing; a file that exists raises and stays
    as it is. Null samples and empty blocks add nothing; an empty table writes
    nothing. Lengths are summed first, as a header needs them.
    """
    if file_format != "wave" and file_format not in FORMATS:
        raise ValueError(f"an unknown format: {file_format}")
    channels, beside = len(LAYOUTS[layout]), channel_list(layout)
    n = F.coalesce(F.size(samples_col), F.lit(0))
    lengths = blocks.groupBy(F.col(file_col).alias("file")).agg(F.sum(F.when(n > 0, n).otherwise(0)).alias("values"))
    rows = blocks.select(F.col(file_col).alias("file"), F.col(order_col).alias("at"), F.col(samples_col).cast("array<int>").alias("samples")).join(lengths, "file")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, done = None, None, []
        store, folder = fs.FileSystem.from_uri(out_dir)
        store.create_dir(folder, recursive=True)

        def close() -> None:
            if out is not None:
                if file_format == "wave" and values * 3 % 2:
                    out.write(b"\0")
                out.close()
                store.move(temporary, f"{folder}/{name}")
                with store.open_output_stream(f"{folder}/{name}.channels.json") as f:
                    f.write(beside.encode())
                done.append((name, values // channels, store.get_file_info(f"{folder}/{name}").size))

        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(0)[k].as_py()
                if own != name:
                    close()
                    name, values = own, batch.column(3)[k].as_py()
                    if store.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                        raise FileExistsError(name)
                    if values % channels:
                        raise ValueError(f"{name}: samples that are no whole frames")
                    temporary = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(temporary, compression=None)
                    if file_format == "wave":
                        out.write(header(channels, mask, values // channels))
                block = batch.column(2)[k]
                if block.is_valid:
                    out.write(FORMATS["s24le" if file_format == "wave" else file_format][1](block.values.to_numpy()))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "frames", "bytes"])

    written = rows.where("file is not null").repartition("file").sortWithinPartitions("file", "at").mapInArrow(files, "file string, frames bigint, bytes bigint").collect()
    return blocks.sparkSession.createDataFrame([tuple(r) for r in written], "file string, frames bigint, bytes bigint")
