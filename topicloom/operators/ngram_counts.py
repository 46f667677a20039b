"""Occurrences and document frequency of n-grams, tallied batch by batch.

A task numbers the stems of an Arrow batch and counts with numpy, so what leaves it
is one row per distinct n-gram of the batch (above single stems, of several batches),
and not one per occurrence. Above
single stems, only n-grams whose parts are known to be frequent are counted, and of
pairs only those whose hash is met often enough. They
are keys made of two numbers: that of the run without its last stem, and that of
the last stem. The known runs are a broadcast. These levels read the places of the
known stems, looked up once, and no strings.

``known_terms`` and ``known_counts`` find the n-grams of a fitted vocabulary in the same
way, so none of the others is ever formed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import pieces

# These functions travel inside the query, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tallied n-grams that a task holds to add up those of its batches, about 100 MB.
HELD_ROWS = 4_000_000
# Numbers that pairs of stems are thrown on, as a power of two, and how many of them are
# shuffled as one row.
BUCKET_BITS, PIECE_BITS = 21, 14
# A number of occurrences that a task counts no further.
MOST = 2**32 - 1


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column and the row each one is of. The elements of a
    column of strings are the words that a space follows."""
    if not pa.types.is_list(column.type):
        return _line_words(column)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def columns_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The first column of the batches in pieces of bounded size."""
    for batch in batches:
        yield from pieces(batch.column(0))


def _line_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(data if data is not None else b"", np.uint8)[bounds[0] : bounds[-1]]
    spaces = data == ord(" ")
    ends = np.flatnonzero(spaces)
    # Without the spaces, each word ends that many places earlier.
    stops = np.concatenate(([0], ends - np.arange(len(ends)))).astype(kind)
    words = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(
        len(ends), pa.py_buffer(stops), pa.py_buffer(data[~spaces])
    )
    sizes = np.diff(np.searchsorted(ends, bounds - bounds[0]))
    return words.cast(pa.string()), np.repeat(np.arange(len(column)), sizes)


def first_places(docs: DataFrame, wanted: Sequence[str], key: str = "doc_id") -> DataFrame:
    """``(key, pos, stem, word)``: the first place of each of the ``wanted`` stems in each
    batch of documents, by key and place, with the word there; in each document, if keys are
    no integers."""
    known = pa.array(wanted, pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems, owners = flat(batch.column(1))
            begins = np.searchsorted(owners, np.arange(batch.num_rows))
            stem = places_of(stems, known)
            at = np.flatnonzero(stem >= 0)
            at = at[np.unique(owners[at] * max(len(known), 1) + stem[at], return_index=True)[1]]
            if pa.types.is_integer(batch.column(0).type):
                rank = pc.rank(batch.column(0), null_placement="at_start", tiebreaker="dense").to_numpy()
                at = at[np.lexsort((at - begins[owners[at]], rank[owners[at]], stem[at]))]
                at = at[np.unique(stem[at], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owners[at])),
                    pa.array(at - begins[owners[at]], pa.int32()),
                    known.take(pa.array(stem[at])),
                    flat(batch.column(2))[0].take(pa.array(at)),
                ],
                names=[key, "pos", "stem", "word"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "stems", "words").mapInArrow(
        run, f"`{key}` {kind}, pos int, stem string, word string"
    )


def tally(codes: np.ndarray, owners: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
    """``(code, n, d)``: occurrences of each code and the rows it occurs in."""
    encoded = pa.array(codes).dictionary_encode()
    found, places = encoded.dictionary.to_numpy(), encoded.indices.to_numpy().astype(np.int64)
    pairs = np.sort(places * rows + owners)
    once = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))] // max(rows, 1)
    return found, np.bincount(places, minlength=len(found)), np.bincount(once, minlength=len(found))


def merged(parts: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The ``(code, n, d)`` of a task's batches with a row per code, as far as ``HELD_ROWS``
    are held; by rising code, in pieces."""

    def joined() -> list[np.ndarray]:
        code, n, d = (np.concatenate(column) for column in zip(*held, strict=True))
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        return [code[first], np.add.reduceat(n[order], first), np.add.reduceat(d[order], first)]

    def pieces(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        for at in range(0, len(columns[0]), HELD_ROWS // 16):
            yield tuple(column[at : at + HELD_ROWS // 16] for column in columns)

    held: list[Sequence[np.ndarray]] = []
    for part in parts:
        if len(part[0]):
            held.append(part)
        if sum(len(code) for code, *_ in held) > HELD_ROWS:
            held = [joined()]
            # Where few rows have met, holding more would not help.
            if len(held[0][0]) > HELD_ROWS // 2:
                yield from pieces(held.pop())
    if held:
        yield from pieces(joined())


def _sums(tallies: DataFrame, key: str, least: float) -> DataFrame:
    sums = tallies.groupBy(key).agg(F.sum("d").alias("df"), F.sum("n").alias("total"))
    return sums.filter(F.col("df") >= least)


def frequent_stems(docs: DataFrame, least: float, stems: str = "stems") -> DataFrame:
    """``(term, df, total)`` of the stems in ``least`` documents or more."""
    return _sums(stem_tallies(docs, stems), "term", least)


def stem_tallies(docs: DataFrame, stems: str = "stems") -> DataFrame:
    """``(term, n, d)``: a row per distinct stem of a batch of documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, owners = flat(batch.column(0))
            encoded = values.dictionary_encode()
            codes = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False)
            known = codes >= 0
            code, n, d = tally(codes[known], owners[known], batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [encoded.dictionary.take(pa.array(code)), pa.array(n), pa.array(d)],
                names=["term", "n", "d"],
            )

    return docs.select(stems).mapInArrow(run, "term string, n long, d long")


def places_of(values: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each value among the known ones, or -1."""
    found = pc.index_in(values, value_set=known, skip_nulls=True)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def extended(runs: np.ndarray, stem: np.ndarray, owners: np.ndarray, n: int, words: int) -> np.ndarray:
    """Keys of the runs of ``n`` stems that begin at each stem, or -1, from the numbers
    of the runs of ``n`` - 1; a run lies in one row."""
    last = stem[n - 1 :]
    runs = runs[: len(last)]
    whole = (runs >= 0) & (last >= 0) & (owners[: len(last)] == owners[n - 1 :])
    return np.where(whole, runs * words + last, -1)


def numbered(keys: np.ndarray, level: pa.Array) -> np.ndarray:
    """The place of each key in a level, or -1."""
    out = np.full(len(keys), -1, dtype=np.int64)
    at = np.flatnonzero(keys >= 0)
    out[at] = places_of(pa.array(keys[at]), level)
    return out


def coded(
    docs: DataFrame, known: list[str], stems: str = "stems", packed: bool = False
) -> DataFrame:
    """``codes``: the place of each stem among the known ones, or -1, of the documents
    that have two of them at least. Packed, those of a document are one value, the bytes of
    32-bit numbers, which is stored and read faster than an array."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(known, pa.string()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in columns_of(batches):
            values, owners = flat(column)
            stem = places_of(values, shared.value)
            several = np.bincount(owners[stem >= 0], minlength=len(column)) >= 2
            sizes = np.bincount(owners, minlength=len(column))[several]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            places = stem[several[owners]].astype(np.int32)
            if packed:
                buffers = [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(places)]
                codes = pa.Array.from_buffers(pa.binary(), len(sizes), buffers)
            else:
                codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places))
            yield pa.RecordBatch.from_arrays([codes], names=["codes"])

    return docs.select(stems).mapInArrow(run, "codes binary" if packed else "codes array<int>")


def flat_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places in a column of ``coded`` and the row each one is of."""
    if pa.types.is_list(column.type):
        values, owners = flat(column)
        return values.to_numpy(zero_copy_only=False).astype(np.int64), owners
    kind = np.dtype(np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize)
    data = np.frombuffer(data if data is not None else b"", np.uint8)[bounds[0] : bounds[-1]]
    owners = np.repeat(np.arange(len(column)), np.diff(bounds) // 4)
    return data.view(np.int32).astype(np.int64), owners


def bucket_of(keys: np.ndarray) -> np.ndarray:
    """The number that each key of a run is thrown on, by multiplicative hashing."""
    spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def full_buckets(codes: DataFrame, least: float, words: int) -> np.ndarray:
    """Which buckets the pairs of known stems fall on ``least`` times or more, from ``coded``
    documents. No other bucket has a pair of so many documents (Park, Chen, Yu 1995). A task
    counts all its pairs in one table of fixed size; the tables are added up piece by piece,
    and a bit for each bucket comes to the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2**BUCKET_BITS, dtype=np.int64)
        for column in columns_of(batches):
            stem, owners = flat_codes(column)
            keys = extended(stem, stem, owners, 2, words)
            counts += np.bincount(bucket_of(keys[keys >= 0]), minlength=len(counts))
        pieces = np.minimum(counts, MOST).astype(np.uint32).reshape(-1, 2**PIECE_BITS)
        for at in np.flatnonzero(pieces.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([pieces[at].tobytes()], pa.binary())], names=["piece", "counts"]
            )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                piece = sums.setdefault(at, np.zeros(2**PIECE_BITS, dtype=np.int64))
                piece += np.frombuffer(counts.as_buffer(), np.uint32)
        full = [np.packbits(piece >= min(least, MOST)).tobytes() for piece in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array(full, pa.binary())], names=["piece", "full"]
        )

    tables = codes.select("codes").mapInArrow(count, "piece long, counts binary")
    out = np.zeros((2 ** (BUCKET_BITS - PIECE_BITS), 2**PIECE_BITS), dtype=bool)
    for row in tables.repartition("piece").mapInArrow(add, "piece long, full binary").collect():
        out[row["piece"]] = np.unpackbits(np.frombuffer(row["full"], np.uint8))
    return out.ravel()


def frequent_runs(
    codes: DataFrame, least: float, known: Sequence[tuple[list[str], np.ndarray]]
) -> DataFrame:
    """``(gram, term, df, total)`` of the n-grams in ``least`` documents or more whose
    parts are all known, from ``coded`` documents.

    ``known`` has the terms of each shorter level with their keys, by rising key. Those
    of single stems are their places. Most pairs of known stems are rare, so only those
    in a bucket that is full are tallied.
    """
    spark = codes.sparkSession
    full = full_buckets(codes, least, len(known[0][0])) if len(known) == 1 else None
    full = spark.sparkContext.broadcast(full)
    shared = spark.sparkContext.broadcast(
        ([pa.array(terms, pa.string()) for terms, _ in known], [pa.array(keys) for _, keys in known])
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, levels = shared.value
        words = len(terms[0])

        def tallied(column: pa.Array) -> tuple[np.ndarray, ...]:
            stem, owners = flat_codes(column)
            runs = stem
            for n, level in enumerate(levels[1:], start=2):
                runs = numbered(extended(runs, stem, owners, n, words), level)
            keys = extended(runs, stem, owners, len(levels) + 1, words)
            at = np.flatnonzero(keys >= 0)
            if full.value is not None:
                at = at[full.value[bucket_of(keys[at])]]
            return tally(keys[at], owners[at], len(column))

        for columns in merged(map(tallied, columns_of(batches))):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["gram", "n", "d"])

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, _ = shared.value
        for batch in batches:
            gram = batch.column(0).to_numpy()
            first = terms[-1].take(pa.array(gram // len(terms[0])))
            last = terms[0].take(pa.array(gram % len(terms[0])))
            term = pc.binary_join_element_wise(first, last, " ")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), term, *batch.columns[1:]], names=["gram", "term", "df", "total"]
            )

    tallies = codes.select("codes").mapInArrow(run, "gram long, n long, d long")
    # A task's rows differ already, so they are dealt out before they are added up.
    return _sums(tallies.repartition("gram"), "gram", least).mapInArrow(
        spell, "gram long, term string, df long, total long"
    )


def _levels(terms: Sequence[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """The stems of ``terms``; the keys of the runs of each length that a term begins
    with, by rising key; and which term each of these runs is, or -1."""
    parts = [term.split(" ") for term in terms]
    words = sorted({part for term in parts for part in term})
    place = {word: at for at, word in enumerate(words)}
    number = [place[term[0]] for term in parts]
    keys, which = [np.arange(len(words), dtype=np.int64)], []
    for n in range(1, max(map(len, parts)) + 1):
        if n > 1:
            key = [a * len(words) + place[term[n - 1]] if len(term) >= n else -1 for a, term in zip(number, parts, strict=True)]
            level = np.array(sorted(set(key) - {-1}), dtype=np.int64)
            number = np.searchsorted(level, key).tolist()
            keys.append(level)
        own = np.full(len(keys[-1]), -1, dtype=np.int64)
        for at, (a, term) in enumerate(zip(number, parts, strict=True)):
            if len(term) == n:
                own[a] = at
        which.append(own)
    return words, keys, which


def _finder(terms: Sequence[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function that gives, for each n-gram of a stems column that is among ``terms``, its
    place there and its row; shorter ones first."""
    words, keys, which = _levels(terms)
    words = pa.array(words, pa.string())
    levels = [pa.array(level) for level in keys]

    def find(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values, owners = flat(column)
        stem = places_of(values, words)
        runs, places, rows = stem, [], []
        for n, (level, own) in enumerate(zip(levels, which, strict=True), start=1):
            if n > 1:
                runs = numbered(extended(runs, stem, owners, n, len(words)), level)
            found = np.where(runs >= 0, own[runs], -1)
            at = np.flatnonzero(found >= 0)
            places.append(found[at])
            rows.append(owners[at])
        return np.concatenate(places), np.concatenate(rows)

    return find


def _starts(rows: np.ndarray, n: int) -> pa.Array:
    """Where the entries of each of ``n`` rows begin, and their end."""
    counts = np.bincount(rows, minlength=n)
    return pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())


def known_terms(terms: Sequence[str], stems: str = "stems") -> Column:
    """The n-grams of ``stems`` that are among ``terms``, shorter ones first; a missing
    text has none."""
    find, named = _finder(terms), pa.array(terms, pa.string())

    def run(column: pa.Array) -> pa.Array:
        places, rows = find(column)
        in_order = named.take(pa.array(places[np.argsort(rows, kind="stable")]))
        return pa.ListArray.from_arrays(_starts(rows, len(column)), in_order)

    return F.arrow_udf(run, "array<string>")(F.col(stems))


def known_counts(terms: Sequence[str], stems: str = "stems") -> Column:
    """How often each of ``terms`` is among the n-grams of ``stems``: a sparse vector by their
    places. That of a missing text has no entry."""
    find, width = _finder(terms), len(terms)

    def run(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([counted(piece) for piece in pieces(column)])

    def counted(column: pa.Array) -> pa.Array:
        places, rows = find(column)
        entries, counts = np.unique(rows * width + places, return_counts=True)
        starts = _starts(entries // width, len(column))
        indices = pa.ListArray.from_arrays(starts, pa.array(entries % width, pa.int32()))
        values = pa.ListArray.from_arrays(starts, pa.array(counts, pa.float64()))
        # Type 0 is a sparse vector.
        kind, size = (pa.array(np.full(len(column), v), t) for v, t in ((0, pa.int8()), (width, pa.int32())))
        return pa.StructArray.from_arrays(
            [kind, size, indices, values], names=["type", "size", "indices", "values"]
        )

    return F.arrow_udf(run, VectorUDT())(F.col(stems))
