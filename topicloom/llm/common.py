"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lower-cases A-Z and turns every ASCII character but letters and digits to a
# space; bytes of other characters stay. What bytes.split() then gives are the
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
WORD_TABLE = bytes(
    b + 32
    if 65 <= b <= 90
    else b
    if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122
    else 32
    for b in range(256)
)
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


def text_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def ddl(df: DataFrame, column: str, name: str | None = None) -> str:
    return f"`{name or column}` {df.schema[column].dataType.simpleString()}"


class WordHashes(dict):
    """64-bit hash of a word, remembered for words met before. Emptied when full,
    so a worker's memory is bounded."""

    def __init__(self, capacity: int = 200_000):
        super().__init__()
        self.capacity = capacity

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.capacity:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


# Odd multipliers that keep the places in a shingle apart.
_PLACES = np.array(
    [xxhash.xxh3_64_intdigest(b"place", seed=i) | 1 for i in range(16)], dtype=np.uint64
)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; a shorter text is one run."""
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total += mix(words[i : len(words) - n + 1 + i]) * _PLACES[i]
    return mix(total)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, which gives the memory it has freed back to the
    system at its end: Spark keeps the worker for the next task."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def byte_column(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(kind).to_pylist()


def sorted_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys. The partition must be sorted by the keys; a
    run is held in memory, and only that run."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for key, rows in itertools.groupby(zip(*columns, strict=True)):
            count = sum(1 for _ in rows)
            part = batch.slice(start, count)
            start += count
            if held and key == current:
                held.append(part)
                continue
            if held:
                yield current, pa.Table.from_batches(held)
            held, current = [part], key
    if held:
        yield current, pa.Table.from_batches(held)
