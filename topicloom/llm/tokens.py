"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

A text is cut at places where the vocabulary's own splitting rule must end a
piece anyway, so the library gives the same ids for the chunks, one by one, as for
the whole. Arrow cuts the texts of a batch and finds the distinct chunks; only
those that were not met before are encoded. This is several times as fast as
encoding every text anew.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Latin letters up to U+024F: a run of them ends a piece where punctuation follows.
# The marks leave out the apostrophe, which may begin a piece with letters, and the
# bars and brackets of special tokens.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = r"""!"#$%&()*+,./:;=?@"""
_BREAK = f"([{_LETTERS}])([{_MARKS}])"
# White space to Python but not to the vocabularies, the one letter whose lower
# case is two characters, and what marks cuts here: texts with these are encoded
# whole.
_ODD = r"[\x{01}\x{1c}-\x{1f}\x{130}]"
# A space after other white space does not begin a piece of its own, so these
# texts are cut by a pattern: white space with what follows it.
_SPACED = (
    r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
)
_PATTERN = re.compile(r"\s*\S+|\s+")

# Bytes of text that are cut at a time, and the longest chunk that is remembered.
PORTION = 4 << 20
LONGEST = 64
# Chunks of a generation that a worker remembers: some 200 bytes each, twice.
CAPACITY = 400_000


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on every core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def keeps_spaces(tokenizer) -> bool:
    """Whether white space is part of the tokens, as in byte-level vocabularies."""
    return tokenizer.encode("\n", add_special_tokens=False).ids != []


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of the texts of about ``PORTION`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PORTION, "right")))
        yield texts.slice(at, stop - at)
        at = stop


class Cut:
    """Texts cut into chunks: ``chunks`` are distinct, ``index`` has one entry per
    chunk of the texts, ``bounds`` where each text's entries begin and end.
    ``whole`` and ``plain`` are rows that are not cut; their text counts as empty
    here."""

    def __init__(self, texts: pa.Array, keep_spaces: bool):
        odd = pc.match_substring_regex(texts, _ODD)
        self.whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        self.plain = np.zeros(0, np.int64)
        left_out = odd
        if keep_spaces:
            spaced = pc.match_substring_regex(texts, _SPACED)
            left_out = pc.or_(odd, spaced)
            self.plain = np.flatnonzero(pc.and_not(spaced, odd).to_numpy(zero_copy_only=False))
        if len(self.whole) or len(self.plain):
            texts = pc.if_else(left_out, pa.scalar("", texts.type), texts)
        if keep_spaces:
            marked = pc.replace_substring(texts, " ", "\x01 ")
            marked = pc.replace_substring_regex(marked, _BREAK, "\\1\x01\\2")
            lists = pc.split_pattern(marked, "\x01")
        else:
            lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _BREAK, r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        self.chunks = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy()
        self.bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)


class Memory:
    """Values of strings met lately. Two generations of ``capacity`` entries at
    most: when the young one is full it becomes the old one, and what is still
    in use comes back from there."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def look_up(self, keys: list[str]) -> tuple[list[Any], list[int]]:
        """Values with None where one is missing, and the places of those."""
        values = list(map(self.young.get, keys))
        if None not in values:
            return values, []
        missing = []
        old = self.old.get
        for i in [i for i, v in enumerate(values) if v is None]:
            value = old(keys[i])
            if value is None:
                missing.append(i)
            else:
                values[i] = self.young[keys[i]] = value
        return values, missing

    def put(self, keys: Iterable[str], values: Iterable[Any]) -> None:
        self.young.update((k, v) for k, v in zip(keys, values, strict=True) if len(k) <= LONGEST)
        if len(self.young) > self.capacity:
            self.old, self.young = self.young, {}


class ChunkEncoder:
    """Values of chunks.

    ``value`` makes the value of a chunk from its ids, ``join`` that of a text from
    those of its chunks. ``fixed`` holds known values, which are never forgotten.
    ``capacity`` bounds what is remembered beside them.
    """

    def __init__(
        self,
        path: str,
        value: Callable[[list[int]], Any],
        join: Callable[[Iterable[Any]], Any],
        fixed: dict[str, Any] | None = None,
        capacity: int = CAPACITY,
    ):
        self.tokenizer = load(path)
        self.keep_spaces = keeps_spaces(self.tokenizer)
        self.value, self.join = value, join
        self.fixed = fixed
        self.memory = Memory(capacity)

    def whole(self, texts: list[str]) -> list[Any]:
        """By the library alone."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [self.value(e.ids) for e in found]

    def of_chunks(self, chunks: list[str]) -> list[Any]:
        """Values of distinct chunks."""
        if self.fixed:
            values = list(map(self.fixed.get, chunks))
            rare = [i for i, v in enumerate(values) if v is None]
            found, holes = self.memory.look_up([chunks[i] for i in rare])
            for i, v in zip(rare, found, strict=True):
                values[i] = v
            missing = [rare[j] for j in holes]
        else:
            values, missing = self.memory.look_up(chunks)
        new = [chunks[i] for i in missing]
        fresh = self.whole(new)
        for i, v in zip(missing, fresh, strict=True):
            values[i] = v
        self.memory.put(new, fresh)
        return values

    def plain(self, texts: list[str]) -> list[Any]:
        """By white space with what follows it."""
        parts = list(map(_PATTERN.findall, texts))
        chunks = list(set().union(*parts))
        get = dict(zip(chunks, self.of_chunks(chunks), strict=True)).__getitem__
        return [self.join(map(get, p)) for p in parts]

    def exceptions(self, cut: Cut, texts: pa.Array) -> Iterator[tuple[int, Any]]:
        """Rows that were not cut, with their values."""
        for rows, encode in ((cut.whole, self.whole), (cut.plain, self.plain)):
            if len(rows):
                yield from zip(rows.tolist(), encode(texts.take(pa.array(rows)).to_pylist()), strict=True)


class IdEncoder(ChunkEncoder):
    """Ids of texts as little-endian unsigned integers of ``width`` (2 or 4) bytes."""

    def __init__(self, path: str, width: int = 4, capacity: int = CAPACITY):
        letter = {2: "H", 4: "I"}[width]
        super().__init__(
            path, lambda ids: struct.pack(f"<{len(ids)}{letter}", *ids), b"".join, None, capacity
        )

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        for part in portions(texts):
            cut = Cut(part, self.keep_spaces)
            data = pa.array(self.of_chunks(cut.chunks), pa.binary()).take(pa.array(cut.index))
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            edges = ends[cut.bounds].tolist() if len(data) else [0] * len(cut.bounds)
            whole = memoryview(data.buffers()[2] or b"")
            out = [bytes(whole[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for row, value in self.exceptions(cut, part):
                out[row] = value
            yield from out


class IdCounter(ChunkEncoder):
    """Numbers of ids of texts; ``fixed`` holds those of frequent chunks."""

    def __init__(self, path: str, fixed: dict[str, int] | None = None):
        super().__init__(path, len, sum, fixed)

    def count_all(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for part in portions(texts):
            cut = Cut(part, self.keep_spaces)
            values = np.array(self.of_chunks(cut.chunks), np.int64)
            sums = np.concatenate([[0], np.cumsum(values[cut.index])])
            counts = sums[cut.bounds[1:]] - sums[cut.bounds[:-1]]
            for row, value in self.exceptions(cut, part):
                counts[row] = value
            out.append(counts)
        return np.concatenate(out)


@lru_cache(maxsize=1)
def id_encoder(path: str, width: int = 4, capacity: int = CAPACITY) -> IdEncoder:
    """The worker's encoder: what one task has met, the next one knows."""
    return IdEncoder(path, width, capacity)
