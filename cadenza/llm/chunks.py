"""Distinct-chunk tables: encode each distinct piece of text once and join the ids back by position.

A chunk is a stretch of text that a tokenizer treats alike wherever it stands.
Each task keeps the chunks it has met, with their ids, in one table; a batch of
texts becomes a list of table slots, and one gather brings the ids together.
When the table outgrows ``limit`` chunks or ``limit_bytes`` of them, chunks met
in one batch only leave it, so memory is bounded.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cadenza.llm.common import SLICE_BYTES, byte_lengths, spans_to_index, strings, text_slices, utf8

#: White space that Python's str.split knows beside Unicode's White_Space property.
SEPARATORS = "[\x1c-\x1f]"
#: White space next to a space: there a byte-level chunk can't begin at the space.
NEAR_SPACE = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |^ "
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
MARKED = re.compile("▁+[^▁]*")
#: Composed Latin text: NFC leaves it as it is and lower case is the same in every library.
SIMPLE = re.compile("[ -~¡-įı-ɏ\ue000]*")

#: Letters of SIMPLE, and marks of one kind to a word tokenizer; not ', which begins endings of words.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-įı-ɏ", r'!-&(-/:-@\[-`{-~'
#: A word of such letters, and marks behind it that a word tokenizer takes as one more word.
PLAIN = re.compile(f"[{LETTERS}]+[{MARKS}]*")

#: A chunk without white space or FENCE: in byte-level vocabularies it may stand next to others.
SOLID = re.compile("[^\\s\ue000]+")

#: A private-use character of which the vocabularies have no piece; stands between joined chunks.
FENCE = "\ue000"

#: Chunks of some texts in text order, and the number of chunks of each text.
Chunks = tuple[pa.Array, np.ndarray]
#: Ids of some chunks in a row, and the number of ids of each chunk.
Encoded = tuple[np.ndarray, np.ndarray]


def in_a_row(encoded: list[Sequence[int]]) -> Encoded:
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    return np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths


def _by_kind(new: list[str], kinds: Sequence[int], ways: list[Callable[[list[str]], Encoded]]) -> Encoded:
    """Chunks encoded 2,000 at once by the way of their kind, in their own order again."""
    order = sorted(range(len(new)), key=kinds.__getitem__)
    edges = np.cumsum([0, *(kinds.count(k) for k in range(len(ways)))]).tolist()
    parts = [way([new[i] for i in order[k : min(k + 2000, end)]]) for way, a, end in zip(ways, edges[:-1], edges[1:], strict=True) for k in range(a, end, 2000)]
    ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
    back = np.argsort(order)
    return ids[spans_to_index((np.cumsum(lengths) - lengths)[back], lengths[back])], lengths[back]


class ChunkTable:
    """Chunks and their ids. ``encode_many`` gives the ids of distinct chunks in a row, and how many each has."""

    def __init__(self, encode_many: Callable[[list[str]], Encoded], limit: int = 200_000, limit_bytes: int = 16_000_000):
        self.encode_many, self.limit, self.limit_bytes = encode_many, limit, limit_bytes
        self.held_bytes = 0
        self.index: dict[str, int] = {}
        self.chunks: list[str] = []
        self.uses = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _add(self, new: list[str]) -> None:
        ids, lengths = self.encode_many(new)
        self.held_bytes += sum(map(len, new))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.index.update(zip(new, range(len(self.chunks), len(self.chunks) + len(new)), strict=True))
        self.chunks += new

    def _prune(self) -> None:
        """Keep what more than one batch has used, the most used half of the limits at most."""
        keep = np.flatnonzero(self.uses > 1)
        keep = keep[np.argsort(-self.uses[keep], kind="stable")][: self.limit // 2]
        sizes = np.fromiter((len(self.chunks[i]) for i in keep.tolist()), np.int64, len(keep))
        fits = np.cumsum(sizes) <= self.limit_bytes // 2
        self.held_bytes, keep = int(sizes[fits].sum()), np.sort(keep[fits])
        self.ids = self.ids[spans_to_index(self.starts[keep], self.lengths[keep])]
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.uses = np.ones(len(keep), np.int32)
        self.chunks = [self.chunks[i] for i in keep.tolist()]
        self.index = dict(zip(self.chunks, range(len(keep)), strict=True))

    def slots(self, chunks: pa.Array) -> np.ndarray:
        """The table slot of every chunk; new chunks are encoded, each once."""
        if len(self.index) > self.limit or self.held_bytes > self.limit_bytes:
            self._prune()
        coded = chunks.dictionary_encode()
        distinct = strings(coded.dictionary)
        at = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = len(self.chunks) + np.arange(len(missing))
            self._add([distinct[i] for i in missing.tolist()])
        self.uses[at] += 1
        return at[coded.indices.to_numpy()] if len(chunks) else at

    def gather(self, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin, with the end."""
        lengths = self.lengths[slots]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[spans_to_index(self.starts[slots], lengths)], ends[bounds]


def _in_text_order(plain: Chunks, odd: list[list[str]], is_odd: np.ndarray) -> Chunks:
    if not odd:
        return plain
    rows = np.concatenate([np.flatnonzero(~is_odd), np.flatnonzero(is_odd)])
    counts = np.concatenate([plain[1], [len(x) for x in odd]]).astype(np.int64)
    values = pa.concat_arrays([plain[0], pa.array(chain.from_iterable(odd), pa.large_string())])
    order = np.argsort(rows)
    return values.take(pa.array(spans_to_index((np.cumsum(counts) - counts)[order], counts[order]))), counts[order]


def _split(texts: pa.Array, odd_pattern: str, split, split_odd: Callable[[str], list[str]]) -> Chunks:
    """``split`` (Arrow) for texts without the odd pattern, ``split_odd`` for the others."""
    is_odd = pc.match_substring_regex(texts, odd_pattern).to_numpy(zero_copy_only=False)
    parts = split(texts.filter(pa.array(~is_odd)) if is_odd.any() else texts)
    counts = pc.list_value_length(parts).to_numpy().astype(np.int64)
    odd = [split_odd(x) for x in strings(texts.filter(pa.array(is_odd)))] if is_odd.any() else []
    return _in_text_order((parts.flatten(), counts), odd, is_odd)


def word_chunks(texts: pa.Array) -> Chunks:
    """For tokenizers that drop white space: what stands between white space."""
    return _split(texts, SEPARATORS, pc.utf8_split_whitespace, lambda x: [x])


def space_chunks(texts: pa.Array) -> Chunks:
    """For byte-level tokenizers whose words take one space before them.

    A chunk begins at each space that stands between two other characters than
    white space. A chunk with its space is keyed by what follows the space; the
    key of a text's first chunk begins with FENCE, as such a text itself would.
    """
    values, counts = _split(texts, NEAR_SPACE, lambda x: pc.split_pattern(x, " "), LONE_SPACE.split)
    first = np.zeros(len(values), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    fenced = pc.starts_with(values, FENCE).to_numpy(zero_copy_only=False) & ~first
    joined = lambda *x: pc.binary_join_element_wise(*x, pa.scalar("", pa.large_string()))
    values, fence, space = values.cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in (FENCE, FENCE + " "))
    return pc.case_when(pc.make_struct(pa.array(first), pa.array(fenced)), joined(fence, values), joined(space, values), values), counts


def _unkeyed(key: str) -> str:
    """The text of a chunk of space_chunks()."""
    return key[1:] if key.startswith(FENCE) else " " + key


def _split_marked(text: str) -> list[str]:
    return [x[1:].replace("▁", " ") for x in MARKED.findall("▁" + text.replace(" ", "▁"))] if text else []


def marked_chunks(texts: pa.Array) -> Chunks:
    """For vocabularies without a piece that crosses a white-space marker.

    A chunk is a run of markers and what follows up to the next marker; its key
    leaves out the first marker, which the library puts in itself.
    """
    return _split(texts, "  |^ |▁|^$", lambda x: pc.split_pattern(x, " "), _split_marked)


@functools.cache
def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a file of the tokenizers library: ``(string, id)``, taken literally wherever they stand in a text."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or re.search(r"\s", x["content"]) for x in added):
        raise ValueError("an added token that isn't taken literally")
    return tuple((x["content"], x["id"]) for x in added)


@functools.cache
def word_table(path: str, limit: int = 300_000) -> ChunkTable:
    """A table for word_chunks() over a file of the tokenizers library, one for each process.

    As the library does by default, it gives the strings of added tokens in a text those tokens' ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    held = re.compile("|".join(re.escape(x) for x, _ in added_tokens(path)) or "(?!)")
    # The same model, held once, for text that the normaliser only sets in lower
    # case; without the library's own cache, which new chunks would only wear out.
    whole.model._resize_cache(0)
    bare = Tokenizer(whole.model)
    bare.pre_tokenizer = whole.pre_tokenizer
    fence = np.array(whole.encode(FENCE, add_special_tokens=False).ids, np.uint32)

    def one_by_one(new: list[str]) -> Encoded:
        return in_a_row([x.ids for x in whole.encode_batch_fast(new, add_special_tokens=False)])

    def joined(new: list[str], simple: bool) -> Encoded:
        text = "".join([f"{x} {FENCE} " for x in new])
        if simple and not SIMPLE.fullmatch(text) or text.count(FENCE) != len(new):
            return one_by_one(new)
        got = (bare if simple else whole).encode_batch_fast([text.lower() if simple else text], add_special_tokens=False)
        ids = np.array(got[0].ids, np.uint32)
        hit = np.ones(len(ids) - len(fence) + 1, bool)
        for j, x in enumerate(fence):
            hit &= ids[j : j + len(hit)] == x
        ends = np.flatnonzero(hit)
        inside = np.ones(len(ids), bool)
        inside[(ends[:, None] + np.arange(len(fence))).ravel()] = False
        return ids[inside], np.diff(ends, prepend=-len(fence)) - len(fence)

    suffix = getattr(whole.model, "end_of_word_suffix", None)
    vocabulary = whole.get_vocab() if suffix else {}
    ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    ends_word[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
    # A plain chunk can't hold an added token that isn't letters, then marks.
    may_be_plain = bool(suffix) and not any(re.fullmatch(f"[{LETTERS}]*[{MARKS}]*", x) for x, _ in added_tokens(path))

    def plain(new: list[str]) -> Encoded:
        """Without fences: the last id of each word has the model's suffix, and a chunk is a word, or a word and its marks."""
        ids = np.array(bare.encode_batch_fast([" ".join(new).lower()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ends_word[ids]) + 1
        words = np.cumsum([2 - x[-1].isalpha() for x in new])
        if len(ends) != words[-1]:
            return one_by_one(new)
        return ids, np.diff(ends[words - 1], prepend=0)

    def encode_many(new: list[str]) -> Encoded:
        # Chunks that hold an added token go to the library one by one.
        kinds = [3 if may_be_plain and PLAIN.fullmatch(x) else 0 if held.search(x) else 1 + bool(SIMPLE.fullmatch(x)) for x in new]
        return _by_kind(new, kinds, [one_by_one, lambda x: joined(x, False), lambda x: joined(x, True), plain])

    return ChunkTable(encode_many, limit)


@functools.cache
def byte_table(path: str, pattern: str, limit: int = 200_000, added: tuple[tuple[str, int], ...] = ()) -> ChunkTable:
    """A table for space_chunks() over a file of byte-level ranks, one for each process.

    Strings of ``added`` tokens in a text get those tokens' ids; without, they are text like any other.
    """
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))
    sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    held = re.compile("|".join(re.escape(x) for x, _ in added) or "(?!)")

    def one_by_one(new: list[str]) -> Encoded:
        return in_a_row([encoding.encode(_unkeyed(x), allowed_special="all") for x in new])

    def joined(new: list[str]) -> Encoded:
        """Chunks in a row, told apart by the bytes of their ids: a chunk begins at each space here, as in a text."""
        text = " " + " ".join(new)
        if held.search(text):
            return one_by_one(new)
        ids = encoding.encode_to_numpy(text, disallowed_special=())
        at = np.cumsum(sizes[ids])
        ends = np.cumsum([1 + (len(x) if x.isascii() else len(x.encode())) for x in new])
        last = np.searchsorted(at, ends)
        if last[-1] >= len(at) or (at[last] != ends).any():
            return one_by_one(new)
        return ids, np.diff(last, prepend=-1)

    def encode_many(new: list[str]) -> Encoded:
        return _by_kind(new, [x is not None for x in map(SOLID.fullmatch, new)], [one_by_one, joined])

    return ChunkTable(encode_many, limit)


def drop_tables() -> None:
    """Forget this process's tables and tokenizers, in stages that encode nothing."""
    word_table.cache_clear()
    byte_table.cache_clear()


def encoded(column: pa.Array, table: ChunkTable, split: Callable[[pa.Array], Chunks]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, ids, bounds)`` for slices of a text column, nulls as empty."""
    texts = utf8(column)
    for a, b in text_slices(byte_lengths(texts), 2 * SLICE_BYTES):
        chunks, counts = split(texts.slice(a, b - a))
        yield a, *table.gather(table.slots(chunks), counts)
