"""Byte-level BPE encoding and decoding with the tokenizers library.

Method: a vocabulary of merge ranks (one base64 token and its rank a line, as
tiktoken reads it) is turned into a tokenizers BPE model. Bytes are written as
printable characters by the byte table below, every token of two or more bytes
gives the merges of its splits into two tokens, ordered by the rank of the token
made, and a token that a piece equals is taken whole (as tiktoken does). Texts
are split by the given pattern, each match encoded separately, without special
tokens. Without offsets, the pattern's matches of an Arrow batch are found in the
task (the ``regex`` module) and each distinct word goes once to the library's
model; with offsets, the texts of a batch go to the library whole, which then
also gives each token's offsets in code points. Both give the same ids. Decoding reverses the byte table: the
bytes of the ids are joined first, so that a character split between tokens is
whole again; ``decode_text`` decodes such bytes as UTF-8 incrementally, so a
stream of ids may end inside a character and go on in the next piece.

Definitions: null texts are empty and give no ids; an empty table gives no
rows. Repeated rows each give their row. Columns other than the key and the
text are not carried, so their names never clash. A very long text is encoded
in one call; the ids of a text are held once as Arrow buffers.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import ddl, slices, text_of, trimmed


def byte_table() -> list[str]:
    """The printable character of each byte: printable Latin-1 bytes stand for
    themselves, the others, in order, for code points from 256 up."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    table, extra = {}, 0
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Pairs of tokens whose join is a token, by the join's rank, then the
    ranks of the two parts."""
    out = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                out.append((rank, ranks[left], ranks[right], left, right))
    out.sort()
    return [(left, right) for *_, left, right in out]


@lru_cache(maxsize=4)
def build(path: str, pattern: str):
    """The tokenizers model of a rank file, built once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    table = byte_table()

    def shown(token: bytes) -> str:
        return "".join(table[b] for b in token)

    ranks = read_ranks(path)
    vocab = {shown(t): r for t, r in ranks.items()}
    merges = [(shown(a), shown(b)) for a, b in merges_of(ranks)]
    tokenizer = Tokenizer(models.BPE(vocab, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


@lru_cache(maxsize=4)
def id_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every id as one buffer and the offsets into it."""
    ranks = read_ranks(path)
    size = max(ranks.values(), default=-1) + 1
    parts = [b""] * size
    for token, rank in ranks.items():
        parts[rank] = token
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=size)
    starts = np.zeros(size + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ``ids`` (uint32), joined: a character split between tokens
    is whole again. Ids outside the vocabulary raise."""
    buffer, starts = id_bytes(path)
    if not len(ids):
        return b""
    ids = ids.astype(np.int64)
    lengths = starts[ids + 1] - starts[ids]
    first = np.repeat(starts[ids] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return buffer[first + np.arange(int(lengths.sum()))].tobytes()


def decode_text(pieces: Iterable[np.ndarray], path: str) -> Iterator[str]:
    """Text of a stream of id arrays; bytes of a character split between two
    arrays wait for the next one. Bytes that are no UTF-8 become U+FFFD."""
    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    for ids in pieces:
        yield decoder.decode(decode_bytes(ids, path))
    yield decoder.decode(b"", final=True)


class Words:
    """Ids without offsets: the pattern's matches, each written by the byte
    table and given to the library's BPE model, which merges by rank; ids of
    words met before are remembered, up to ``capacity`` words of at most
    ``LONGEST`` characters, and forgotten all at once when full."""

    LONGEST = 64

    def __init__(self, tokenizer, pattern: str, capacity: int = 200_000):
        import regex

        self.model = tokenizer.model
        self.split = regex.compile(pattern).findall
        self.shown = {b: c for b, c in enumerate(byte_table())}
        self.known: dict[str, list[int]] = {}
        self.capacity = capacity

    def ids(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            got = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]
            if len(word) <= self.LONGEST:
                if len(self.known) >= self.capacity:
                    self.known.clear()
                self.known[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        out: list[int] = []
        for word in self.split(text or ""):
            out += self.ids(word)
        return np.asarray(out, dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def worker_words(path: str, pattern: str) -> Words:
    """A worker's ``Words``, kept between its tasks."""
    return Words(build(path, pattern), pattern)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    with_offsets: bool = False,
) -> DataFrame:
    """``key, ids`` (binary: little-endian unsigned 32-bit ids) and, with
    ``with_offsets``, ``starts, ends`` (code points of the text, per token)."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = build(ranks_path, pattern)
        words = worker_words(ranks_path, pattern)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            if not with_offsets:
                ids = [words.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.large_binary())], names=["key", "ids"]
                )
                continue
            encoded = tokenizer.encode_batch(texts, add_special_tokens=False) if texts else []
            ids = [np.asarray(e.ids, dtype="<u4").tobytes() for e in encoded]
            columns = [batch.column(0), pa.array(ids, pa.large_binary())]
            if with_offsets:
                for side in (0, 1):
                    columns.append(
                        pa.array([[o[side] for o in e.offsets] for e in encoded], pa.list_(pa.int64()))
                    )
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "starts", "ends"][: len(columns)])

    schema = f"{ddl(docs, key, 'key')}, ids binary"
    if with_offsets:
        schema += ", starts array<long>, ends array<long>"
    out = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, ids, decoded`` (binary): the bytes of each row's ids."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = batch.column(1).to_pylist()
            out = [
                None if v is None else decode_bytes(np.frombuffer(v, dtype="<u4"), ranks_path)
                for v in values
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.large_binary())],
                names=["key", "ids", "decoded"],
            )

    schema = f"{ddl(encoded, key, 'key')}, ids binary, decoded binary"
    picked = encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)
