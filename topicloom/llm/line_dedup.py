"""Line dedup by winnowing: later repeats of runs of lines are deleted.

Lines are what stands between line breaks, cut once more after the end of a
sentence, so that a passage inside a paragraph is a run of lines too. The gram of
a line is the shortest run of lines from it on with ``gram_words`` words or more.
Windows are the shortest runs with ``min_words`` words or more, those from a line
on and those up to a line: every line of a longer run lies in a window within it.
Of the grams within a window from a line on, one with the least hash is selected as
a fingerprint (the one selected last, as long as no lesser hash comes in, so that
a text that repeats itself has few). The least hash in a window depends on its own
lines alone, so two places that share a run of ``min_words`` words share a
fingerprint's hash in it: the guarantee of winnowing.

Fingerprints only tell which windows can be in more than one document: those that
hold a gram whose hash is a fingerprint of several. These windows meet the first
document of all that have the same window, in the order of key, by a hash of all
their lines; so every repeated window meets a document that really holds it,
whatever documents share a part of it, and a window that a third of all documents
have gives one row for each, not pairs. A document's own windows are compared where
it is read. What lies in a window that begins at an earlier place, too, is deleted:
these are all runs of ``min_words`` words or more that are repeated. First places
are never deleted on their own account.

Lines and windows are compared by 64-bit hashes, without the white space around
lines. Null and empty texts have no lines and stay as they are. Rows that repeat a key are one
after the other in the order of their texts' hashes; rows equal in key and text
are one document, and stay or change together. Rows without a key are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import byte_column, mix, slices, text_of, trimmed
from topicloom.session import materialize

MIN_WORDS = 40
GRAM_WORDS = 20

# A line ends at a line break, or with the white space after a sentence's end. Gaps are only
# looked for where white space is.
_GAP = re.compile(rb"""[ \t\n](?:(?<=\n)|(?:(?<=[.!?][ \t])|(?<=[.!?]["')\]][ \t]))[ \t]*)""")
_SENTENCE_END = re.compile(rb"""([.!?]["')\]]?)[ \t]+""")
# An odd number and its inverse modulo 2**64, for hashes of runs of lines.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def lines_of(text: bytes) -> list[bytes]:
    """All lines with what ends them; joined they are the text."""
    ends = [m.end() for m in _GAP.finditer(text)] + [len(text)]
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def split_lines(text: bytes) -> list[bytes]:
    """All lines without what ends them."""
    return _SENTENCE_END.sub(rb"\1\n", text).split(b"\n")


def hashed_lines(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """Hash, number of words and number of each line with words."""
    hashes, words, numbers = [], [], []
    for i, line in enumerate(split_lines(text)):
        if n := len(line.split()):
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()))
            words.append(n)
            numbers.append(i)
    return hashes, words, numbers


def _powers(base: np.uint64, n: int = 4_096) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64))


# Those that most texts need are made once.
_RISING, _FALLING = _powers(_BASE), _powers(_INVERSE)


class Runs:
    """Hashes of runs of lines, from ``starts`` to ``stops`` (exclusive)."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        few = n <= len(_RISING)
        rising = _RISING[:n] if few else _powers(_BASE, n)
        self.falling = _FALLING if few else _powers(_INVERSE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes) * rising, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        sums = (self.sums[stops] - self.sums[starts]) * self.falling[starts]
        return mix(sums) + (stops - starts).astype(np.uint64)


def _ends(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before each line, and the line after the last of the shortest run from
    each line on with ``least`` words; beyond all lines if there is none."""
    before = np.concatenate([[0], np.cumsum(words)])
    return before, np.searchsorted(before, before[:-1] + least)


def fingerprints(hashes: np.ndarray, words: np.ndarray, gram_words: int, min_words: int) -> list[tuple[int, int]]:
    """``(hash, line)`` of the selected grams."""
    n = len(hashes)
    gram_end, window_end = _ends(words, gram_words)[1], _ends(words, min_words)[1]
    windows = int(np.count_nonzero(window_end <= n))
    if not windows:
        return []
    grams = Runs(hashes).hashes(np.arange(n), np.minimum(gram_end, n)).tolist()
    last = (np.searchsorted(gram_end, window_end[:windows], "right") - 1).tolist()
    chosen, best, tried = [], -1, -1
    for start, stop in enumerate(last):
        if best < start:
            best, tried = start, start
            for i in range(start + 1, stop + 1):
                if grams[i] <= grams[best]:
                    best = i
        else:
            for i in range(tried + 1, stop + 1):
                if grams[i] < grams[best]:
                    best = i
        tried = max(tried, stop)
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [(grams[i], i) for i in sorted(set(chosen))]


def windows_of(hashes: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop of each window: the shortest runs from a line on, then
    those up to a line that are not among them."""
    n = len(hashes)
    before, ends = _ends(words, min_words)
    starts = np.flatnonzero(ends <= n)
    stops = np.flatnonzero(before >= min_words)
    froms = np.searchsorted(before, before[stops] - min_words, "right") - 1
    other = ends[froms] != stops
    starts, stops = np.concatenate([starts, froms[other]]), np.concatenate([ends[starts], stops[other]])
    return Runs(hashes).hashes(starts, stops), starts, stops


def firsts_and_repeats(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a document are the first of their hash in it, and which
    are not."""
    order = np.lexsort((starts, hashes))
    ordered = hashes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return order[first], order[~first]


def with_gram(hashes: np.ndarray, words: np.ndarray, gram_words: int, shared: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether one of the ``shared`` grams lies in each window."""
    n = len(hashes)
    gram_end = _ends(words, gram_words)[1]
    grams = Runs(hashes).hashes(np.arange(n), np.minimum(gram_end, n))
    held = np.concatenate([[0], np.cumsum(np.isin(grams, shared) & (gram_end <= n))])
    # Grams of a window start before the first whose end is beyond it.
    return held[np.searchsorted(gram_end, stops, "right")] > held[starts]


def places(numbers: list[int] | None, n: int, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of runs among all lines, and the next line with words."""
    number = np.arange(n + 1) if numbers is None else np.array([*numbers, numbers[-1] + 1])
    return number[starts], number[stops - 1] + 1, number[stops]


def joined(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs ``(start, stop, next)`` that overlap or meet as one."""
    out: list[tuple[int, int, int]] = []
    for start, stop, following in sorted(spans):
        if out and start <= out[-1][2]:
            start, stop, following = out[-1][0], max(stop, out[-1][1]), max(following, out[-1][2])
            out.pop()
        out.append((start, stop, following))
    return out


def _row_id(key: str) -> Column:
    """Order and identity of a document: its key, then its text's hash, which only
    has to tell rows of one key apart."""
    return F.struct(F.col(key).alias("key"), F.hash("text").alias("hash"))


def repeated_runs(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    gram_words: int = GRAM_WORDS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``id (key, hash), spans``: for each document with repeats, the deleted runs
    of lines, numbered among all its lines, stop exclusive."""
    kind = docs.schema[key].dataType.simpleString()
    id_kind = f"struct<key:{kind},hash:int>"
    span = pa.struct([(c, pa.int32()) for c in ("start", "stop", "next")])

    @trimmed
    def fingerprint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"lines": pa.int64(), "words": pa.int32(), "numbers": pa.int32(), "grams": pa.int64(), "repeats": span}
        for batch in slices(batches):
            columns: list[list] = [[] for _ in kinds]
            for value in byte_column(batch, "text"):
                hashes, words, numbers = hashed_lines(value)
                lines, counts = np.array(hashes, np.uint64), np.array(words, np.int64)
                # The numbers are left out where every line has words.
                numbers = numbers if numbers and numbers[-1] >= len(numbers) else None
                grams = {h for h, _ in fingerprints(lines, counts, gram_words, min_words)}
                repeats = []
                if grams:
                    found, starts, stops = windows_of(lines, counts, min_words)
                    own: tuple = ()
                    if len(set(found.tolist())) < len(found):
                        again = firsts_and_repeats(found, starts)[1]
                        own = places(numbers, len(lines), starts[again], stops[again])
                    repeats = [dict(zip(("start", "stop", "next"), s, strict=True)) for s in joined(zip(*(c.tolist() for c in own), strict=True))]
                row = (lines.view(np.int64), words, numbers, np.array(list(grams), np.uint64).view(np.int64), repeats)
                for column, values in zip(columns, row, strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds.values(), strict=True))],
                names=["id", *kinds],
            )

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key), text_of(text).alias("text"))
    lined = materialize(
        rows.select(_row_id(key).alias("id"), "text")
        .mapInArrow(
            fingerprint,
            f"id {id_kind}, lines array<bigint>, words array<int>, numbers array<int>, "
            "grams array<bigint>, repeats array<struct<start:int,stop:int,next:int>>",
        )
        .where(F.size("grams") > 0),
        "lines",
    )
    prints = lined.select("id", F.explode("grams").alias("gram"))
    ends = [f(f"id.{c}").alias(f"{n}_{c}") for c in ("key", "hash") for f, n in ((F.min, "low"), (F.max, "high"))]
    several = prints.groupBy("gram").agg(*ends).where("low_key < high_key or low_hash < high_hash").select("gram")
    shared = prints.join(several, "gram").groupBy("id").agg(F.collect_list("gram").alias("shared"))

    @trimmed
    def unfold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, columns = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in range(4)]
            values = (batch.column(c).to_pylist() for c in ("lines", "words", "numbers", "shared"))
            for i, (lines, words, numbers, grams) in enumerate(zip(*values, strict=True)):
                hashes, counts = np.array(lines, np.int64).view(np.uint64), np.array(words, np.int64)
                found, starts, stops = windows_of(hashes, counts, min_words)
                met = with_gram(hashes, counts, gram_words, np.array(grams, np.int64).view(np.uint64), starts, stops)
                found, starts, stops = found[met], starts[met], stops[met]
                first = firsts_and_repeats(found, starts)[0] if len(found) else np.zeros(0, np.int64)
                own = places(numbers, len(lines), starts[first], stops[first])
                at.append(np.full(len(first), i))
                for column, part in zip(columns, (found[first].view(np.int64), *own), strict=True):
                    column.append(part)
            window, *spots = (np.concatenate(c) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.concatenate(at))), pa.array(window), *(pa.array(c.astype(np.int32)) for c in spots)],
                names=["id", "window", "start", "stop", "next"],
            )

    windows = materialize(
        shared.join(lined.select("id", "lines", "words", "numbers"), "id").mapInArrow(
            unfold, f"id {id_kind}, window bigint, start int, stop int, next int"
        ),
        "windows",
    )
    first = windows.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    later = windows.join(first.select("window", "first"), "window").where("id <> first")
    repeats = later.select("id", F.struct("start", "stop", "next").alias("s")).unionByName(
        lined.select("id", F.explode("repeats").alias("s"))
    )

    @trimmed
    def join_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [
                [{"start": a, "stop": b} for a, b, _ in joined(tuple(s.values()) for s in spans)]
                for spans in batch.column("spans").to_pylist()
            ]
            spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, spans_kind)], names=["id", "spans"])

    return (
        repeats.groupBy("id")
        .agg(F.collect_list("s").alias("spans"))
        .mapInArrow(join_spans, f"id {id_kind}, spans array<struct<start:long,stop:long>>")
    )


@trimmed
def _without(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in rows:
        out = []
        for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if not cut:
                out.append({"text": text, "n_lines": 0, "n_words": 0})
                continue
            lines = lines_of(text.encode())
            gone = np.zeros(len(lines), dtype=bool)
            for s in cut:
                gone[s["start"] : s["stop"]] = True
            kept = b"".join(x for x, g in zip(lines, gone, strict=True) if not g)
            words = sum(len(x.split()) for x, g in zip(lines, gone, strict=True) if g)
            out.append({"text": kept.decode(), "n_lines": int(gone.sum()), "n_words": words})
        yield pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_words", pa.int64())]))


def dedup_lines(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    gram_words: int = GRAM_WORDS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Each document as ``row`` (all its columns) with ``cleaned``: its ``text``
    without the repeated runs, and the lines and words removed."""
    runs = repeated_runs(docs, min_words, gram_words, key, text)
    runs = runs.select(F.col("id.key").alias("run_key"), F.col("id.hash").alias("run_hash"), "spans")
    rows = docs.select(F.struct("*").alias("row"), text_of(text).alias("run_text"))
    joined = rows.join(
        runs,
        (F.col(f"row.`{key}`") == F.col("run_key")) & (F.hash("run_text") == F.col("run_hash")),
        "left",
    )
    without = F.arrow_udf(_without, "struct<text:string,n_lines:long,n_words:long>")
    # Texts without repeats do not go to Python.
    alone = F.struct(F.col("run_text").alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_words"))
    cleaned = F.when(F.col("spans").isNull(), alone).otherwise(
        without(F.when(F.col("spans").isNotNull(), F.col("run_text")), "spans")
    )
    return joined.select("row", "spans", cleaned.alias("cleaned"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """The documents with their repeated runs deleted; one of which no word is left
    goes as a whole."""
    found = dedup_lines(docs, key=key, text=text, **limits)
    kept = found.where(F.col("spans").isNull() | F.col("cleaned.text").rlike(r"[^ \t\n\x0B\f\r]"))
    new = F.when(F.col("spans").isNull(), F.col(f"row.`{text}`")).otherwise(F.col("cleaned.text"))
    return kept.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
