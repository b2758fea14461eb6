"""SentencePiece encoding and decoding over a table of distinct marked words."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.chunks import ChunkTable, in_a_row, marked_chunks
from cadenza.llm.common import byte_lengths, SLICE_BYTES, text_slices, tidied, utf8

#: Column name and type of what encode_texts() can return.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


@functools.cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def piece_table(path: str, limit: int = 500_000) -> ChunkTable:
    """A table for marked_chunks() over a SentencePiece model, one for each process.

    Raises ValueError for a vocabulary that the chunks don't suit: one with a
    piece in which a marker follows another character, or without byte pieces.
    """
    sp = _processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    if any("▁" in x.lstrip("▁") for x in pieces) or not any(map(sp.is_byte, range(len(pieces)))):
        raise ValueError(f"{path}: pieces cross white-space markers, or bytes have no pieces")
    marker = sp.piece_to_id("▁")
    return ChunkTable(lambda new: in_a_row([x or [marker] for x in sp.encode(new, num_threads=1)]), limit)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _codec(batches: Iterator[pa.RecordBatch], path: str, outputs: Sequence[str], bos: bool, eos: bool) -> Iterator[pa.RecordBatch]:
    sp, table = _processor(path), piece_table(path)
    head, tail = [sp.bos_id()] * bos, [sp.eos_id()] * eos
    decoding = any(x.startswith("decoded") for x in outputs)
    for batch in batches:
        texts = utf8(batch.column(1))
        for a, b in text_slices(byte_lengths(texts), 2 * SLICE_BYTES):
            chunks, counts = marked_chunks(texts.slice(a, b - a))
            slots = table.slots(chunks)
            ids, bounds = table.gather(slots, counts)
            columns: dict[str, list] = {x: [] for x in outputs}
            if decoding:
                # A chunk decodes without its first marker, as a whole text does: markers between chunks are spaces.
                distinct, at = np.unique(slots, return_inverse=True)
                lengths, starts = table.lengths[distinct].tolist(), table.starts[distinct].tolist()
                words = sp.decode([table.ids[s : s + n].tolist() for s, n in zip(starts, lengths, strict=True)], num_threads=1) if len(distinct) else []
                spelt = np.array(words, object)[at].tolist() if len(distinct) else []
            ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for k in range(b - a):
                own = np.concatenate([head, ids[bounds[k] : bounds[k + 1]], tail]).astype("<u4")
                text = " ".join(spelt[ends[k] : ends[k + 1]]) if decoding else ""
                for x in outputs:
                    columns[x].append(own.astype(np.int32) if x == "ids" else text if x == "decoded" else len(own) if x == "n_tokens" else _sha(own.tobytes()) if x == "ids_sha256" else _sha(text.encode()))
            types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(columns[x], types.get(x, pa.string())) for x in outputs)], names=["doc_id", *outputs])


def encode_texts(
    documents: DataFrame, model_path: str, outputs: Sequence[str] = ("ids",), id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True
) -> DataFrame:
    """Ids of every whole text exactly as the sentencepiece library gives them, and the text decoded from them.

    Returns one row per input row: ``doc_id`` and the columns of ``outputs``
    (see OUTPUTS). Null and empty texts have the begin and end ids only and
    decode to an empty text; a null id stays null; repeated rows give repeated
    rows; other columns are not read. A narrow operator: no shuffle.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    outputs = list(outputs)
    schema = ", ".join([f"doc_id {kind}", *(f"{x} {OUTPUTS[x]}" for x in outputs)])
    return documents.select(documents[id_col], documents[text_col]).mapInArrow(tidied(lambda it: _codec(it, model_path, outputs, bos, eos)), schema)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text``: id arrays decoded by the library; a null array gives an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_processor(model_path).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col], encoded[ids_col]).mapInArrow(decode, f"doc_id {kind}, text string")
