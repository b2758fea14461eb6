"""Chat formatting: conversations as token ids with a loss mask, and as escaped text.

Every role has an opening and a closing control string, each one reserved id
above the vocabulary. A turn's text is escaped, so that no control string is
left in it, encoded on its own, so that no token crosses a marker, and the
reserved ids are spliced in around it. The loss mask is the running sum of +1
where an assistant text begins and -1 where it ends. All of it can be undone.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.chunks import byte_table, encoded, space_chunks
from cadenza.llm.common import shared_dir, staged, strings, utf8

#: Control strings that open and close a turn of a role, and one between the name and text of any other role.
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[TEXT]", "[/TURN]")
CONTROL = [x for pair in TURNS.values() for x in pair] + list(OTHER)
ESCAPE = "\\"
_FOUND = re.compile("|".join(map(re.escape, [*CONTROL, ESCAPE])))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
_MARKERS = re.compile("(" + "|".join(map(re.escape, CONTROL)) + ")")

TURN_SCHEMA = "conv_id bigint, place bigint, formatted string, ids array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    """Double escape characters, and put one behind the first character of each control string."""
    return _FOUND.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    """Undo escape()."""
    return _ESCAPED.sub(lambda m: m[1], text)


def _segments(role: str, text: str) -> list[tuple[str, bool]]:
    """A turn as ``(string, whether it is a control string)``."""
    if role in TURNS:
        return [(TURNS[role][0], True), (escape(text), False), (TURNS[role][1], True)]
    return [(OTHER[0], True), (escape(role), False), (OTHER[1], True), (escape(text), False), (OTHER[2], True)]


def _format(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, reserved: int) -> Iterator[pa.RecordBatch]:
    table, special = byte_table(ranks_path, pattern), {x: reserved + k for k, x in enumerate(CONTROL)}
    for batch in batches:
        roles, texts = strings(utf8(batch.column(2))), strings(utf8(batch.column(3)))
        turns = [_segments(r, t) for r, t in zip(roles, texts, strict=True)]
        contents = pa.array([s for turn in turns for s, control in turn if not control], pa.large_string())
        own = [ids[i:j] for _, ids, bounds in encoded(contents, table, space_chunks) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        taken, columns = iter(own), ([], [], [])
        for role, turn in zip(roles, turns, strict=True):
            parts = [np.array([special[s]], np.uint32) if control else next(taken) for s, control in turn]
            ends = np.cumsum([len(x) for x in parts])
            steps = np.zeros(ends[-1] + 1, np.int64)
            if role == "assistant":
                steps[ends[0]] += 1
                steps[ends[1]] -= 1
            columns[0].append("".join(s for s, _ in turn))
            columns[1].append(np.concatenate(parts).astype(np.int32))
            columns[2].append(np.cumsum(steps[:-1]) > 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.bool_()))],
            names=["conv_id", "place", "formatted", "ids", "loss_mask"],
        )


def format_conversations(
    conversations: DataFrame, ranks_path: str, pattern: str, reserved: int = 50_257, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The turns of every conversation, formatted: ``conv_id, place, formatted, ids, loss_mask``.

    A conversation is its rows in the order of ``place`` (its turn number); the
    concatenation of ``formatted`` is its text, that of ``ids`` its sequence.
    Rows stay apart so that a conversation of any length can be shuffled, split
    and streamed. Null texts and roles count as empty; an empty or unknown role
    is written out between the markers of OTHER; null ids or turn numbers are
    kept as null and sort first; repeated rows are repeated turns; an empty
    table gives no rows; other columns are not read. A narrow operator.
    """
    rows = conversations.select(conversations[conv_col].cast("bigint"), conversations[turn_col].cast("bigint"), conversations[role_col], conversations[text_col])
    return rows.mapInArrow(lambda it: _format(it, ranks_path, pattern, reserved), TURN_SCHEMA)


@functools.cache
def _decoder(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns ``(role, text)`` of a formatted text."""
    opening, turns, parts = {a: role for role, (a, _) in TURNS.items()}, [], [x for x in _MARKERS.split(formatted) if x]
    at = 0

    def content() -> str:
        nonlocal at
        if parts[at] in CONTROL:
            return ""
        at += 1
        return unescape(parts[at - 1])

    while at < len(parts):
        mark, at = parts[at], at + 1
        role = content() if mark == OTHER[0] else opening[mark]
        if mark == OTHER[0]:
            at += 1
        turns.append((role, content()))
        at += 1
    return turns


def conversation_digests(formatted: DataFrame, ranks_path: str, pattern: str, reserved: int = 50_257) -> DataFrame:
    """Read formatted conversations back: what their text, ids and loss mask say, as digests.

    Returns per conversation ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``. Roles and texts are parsed from the
    formatted text; the text under the loss mask is decoded from the masked ids
    and unescaped. Raises ValueError if ids and text differ. Rows stream
    through in order; a task holds one turn and the running digests, however
    long the conversation.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(ranks_path, pattern)
        current, began, rows = None, False, []

        def close() -> None:
            if began:
                rows.append((current, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            rows.clear()
            return out

        for batch in batches:
            ids_column, mask_column = batch.column(3), batch.column(4)
            offsets = ids_column.offsets.to_numpy()
            all_ids, all_mask = ids_column.values.to_numpy(), mask_column.values.to_numpy(zero_copy_only=False)
            for k, (conv, text) in enumerate(zip(batch.column(0).to_pylist(), strings(batch.column(2)), strict=True)):
                if not began or conv != current:
                    close()
                    current, began = conv, True
                    n_turns, turns, loss_chars, loss, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                ids, mask = all_ids[offsets[k] : offsets[k + 1]], all_mask[offsets[k] : offsets[k + 1]]
                plain = "".join(decoder.decode(run.tolist()) if run[0] < reserved else "".join(CONTROL[x - reserved] for x in run.tolist()) for run in np.split(ids, np.flatnonzero(np.diff(ids >= reserved)) + 1) if len(run))
                if plain != text:
                    raise ValueError(f"conversation {conv}: its ids spell another text")
                for role, said in parse(text):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                learnt = unescape(decoder.decode(ids[mask].tolist()))
                loss_chars += len(learnt)
                loss.update(learnt.encode())
                chars += len(text)
            if len(rows) >= 1000:
                yield flush()
        close()
        if rows:
            yield flush()

    order = ["conv_id", "place", "formatted"]
    return formatted.select("conv_id", "place", "formatted", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(read, schema)


def write_conversations(formatted: DataFrame) -> DataFrame:
    """Write formatted turns to the shared folder and return them read back."""
    return staged(formatted, shared_dir(formatted.sparkSession, "chat"))


def with_probe(conversations: DataFrame, conv_id: int, text: str) -> DataFrame:
    """The conversations' four columns and one more conversation, a user and an assistant turn of the same text."""
    probe = conversations.sparkSession.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionAll(probe)
