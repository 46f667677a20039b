"""Katz backoff scores of texts under a bigram model of the corpus.

A token's probability after its predecessor is, for a bigram that training saw,
its count, discounted by Good-Turing, over the predecessor's count; otherwise it
backs off to the unigram, times the weight of the predecessor that makes all
probabilities after it add up to exactly 1. Unigrams are discounted likewise, and
what they leave goes to the one class of unknown words. Counts up to ``CUTOFF``
are discounted by Good-Turing (half a count where the counts of counts allow no
such estimate), larger ones by the share ``1/(N+1)``, so every weight is positive.

Jobs. Words are 64-bit hashes. A first pass counts words; those that make up more
than ``1/HOT_SHARE`` of all tokens (``HOT_SHARE`` words at most) are broadcast.
A second pass writes, per batch of documents and bucket of words, which bigrams
the documents have, packed; buckets are hashes of the word, or of the bigram for
the hot words, so no bucket grows with a frequent word. A task per bucket then
counts its bigrams and gives, of every document and of every predecessor, partial
sums in which the discounts are still open: numbers of tokens by count. These,
the n-gram tables, are stored. Discounts, backoff weights and scores are ordinary
aggregates of them.

Null texts are empty: one end token. Rows that repeat a key are scored each.
Without training documents every word is unknown and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import LOWER_TABLE, WordHashes, byte_column, mix, slices, sorted_groups, text_of, trimmed
from topicloom.session import materialize

CUTOFF = 5
HOT_SHARE = 1000
BATCH_TOKENS = 1_000_000
BATCH_DOCS = 60_000

# A space is in no word, so these are no words' hashes by construction.
END = xxhash.xxh3_64_intdigest(b" end")
START = xxhash.xxh3_64_intdigest(b" start")


class Discounts:
    """What a count is multiplied by."""

    def __init__(self, counts_of_counts: list[int], total: int):
        """``counts_of_counts``: how many n-grams occur 1 to ``CUTOFF + 1`` times."""
        n = counts_of_counts
        k = CUTOFF
        self.large = 1 - 1 / (total + 1)
        low = (k + 1) * n[k] / n[0] if n[0] else 1.0
        self.small = []
        for r in range(1, k + 1):
            rate = 0.0
            if n[r - 1] and low < 1:
                rate = ((r + 1) * n[r] / (r * n[r - 1]) - low) / (1 - low)
            if not 0 < rate < self.large:
                rate = (r - 0.5) / r
            self.small.append(min(rate, self.large))

    def table(self) -> np.ndarray:
        """By count; index ``CUTOFF + 1`` stands for all larger ones."""
        return np.array([1.0, *self.small, self.large])


class Unigrams:
    def __init__(self, total: int, counts_of_counts: list[int]):
        self.total = total
        self.rates = Discounts(counts_of_counts, total).table()
        kept = sum((1 - d) * r * n for r, (d, n) in enumerate(zip(self.rates[1:-1], counts_of_counts), 1))
        held = sum(r * n for r, n in enumerate(counts_of_counts[:CUTOFF], 1))
        self.unknown = (kept + (1 - self.rates[-1]) * (total - held)) / total if total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        seen = self.rates[np.minimum(counts, CUTOFF + 1)] * counts / max(1, self.total)
        return np.where(counts > 0, seen, self.unknown)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays by byte planes, compressed."""
    head = np.array([len(arrays)] + [v for a in arrays for v in (len(a), a.itemsize)], "<u4")
    planes = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *planes]))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", 2 * count, 4).reshape(count, 2).tolist()
    at, out = 4 + 8 * count, []
    for n, width in sizes:
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += n * width
    return out


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list, list[bool]]]:
    """Documents in groups of bounded size: token hashes with the end, keys, and
    whether they train. Input columns: key, train, text."""
    hashes = WordHashes()
    arrays: list[np.ndarray] = []
    keys: list = []
    train: list[bool] = []
    size = 0
    for batch in slices(batches):
        columns = [batch.column(c).to_pylist() for c in ("key", "train")]
        for key, trains, text in zip(*columns, byte_column(batch, "text"), strict=True):
            words = text.translate(LOWER_TABLE).split()
            words.append(b" end")
            arrays.append(hashes.of(words))
            keys.append(key)
            train.append(trains)
            size += len(words)
            if size >= BATCH_TOKENS or len(keys) >= BATCH_DOCS:
                yield arrays, keys, train
                arrays, keys, train, size = [], [], [], 0
    if keys:
        yield arrays, keys, train


def count_words(rows: DataFrame) -> DataFrame:
    """``word, n_train, n_all`` by word hash, from ``key, train, text``."""

    @trimmed
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays, _, train in _hashed(batches):
            tokens = np.concatenate(arrays)
            trains = np.repeat(np.array(train, bool), [len(a) for a in arrays])
            words, inverse = np.unique(tokens, return_inverse=True)
            columns = [
                pa.array(words.view(np.int64)),
                pa.array(np.bincount(inverse[trains], minlength=len(words)).astype(np.int64)),
                pa.array(np.bincount(inverse).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_train", "n_all"])

    counted = rows.mapInArrow(count, "word long, n_train long, n_all long")
    return counted.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def _runs(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(sorted_arrays[0]), dtype=bool)
    new[:1] = True
    for a in sorted_arrays:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _bigrams(rows: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """``bucket, base, payload, keys, train``: the bigrams of a batch's documents
    in one bucket. Keys come with one of the batch's buckets only."""

    @trimmed
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (arrays, keys, train) in enumerate(_hashed(batches)):
            batch_id = (part << 20) + seq
            lengths = np.array([len(a) for a in arrays])
            starts = np.cumsum(lengths) - lengths
            words, w = np.unique(np.concatenate(arrays), return_inverse=True)
            arrays.clear()
            w = w.astype(np.int32)
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[starts] = len(words)
            histories = np.append(words, np.uint64(START))
            docs = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            place = (mix(words) % np.uint64(buckets)).astype(np.int64)[w]
            spread = np.flatnonzero(np.isin(words, hot)[w])
            both = mix(words)[w[spread]] + histories[h[spread]]
            place[spread] = (mix(both) % np.uint64(buckets)).astype(np.int64)
            bits = max(1, int(len(histories)).bit_length())
            if 2 * bits + int(buckets).bit_length() < 63:
                place <<= 2 * bits
                place |= w.astype(np.int64) << bits
                place |= h
                order = np.argsort(place, kind="stable").astype(np.int32)
                place = (place >> (2 * bits)).astype(np.int32)
            else:
                order = np.lexsort((h, w, place))
            place, w, h, docs = place[order], w[order], h[order], docs[order]
            del order
            trains = np.array(train, bool)
            # An entry is a document's bigram; a pair is a bigram.
            entry = _runs(place, w, h, docs)
            times = np.diff(np.append(entry, len(docs)))
            place, w, h, docs = place[entry], w[entry], h[entry], docs[entry]
            pair = _runs(place, w, h)
            bounds = np.searchsorted(place[pair], np.arange(buckets + 1))
            trained = np.add.reduceat(times * trains[docs], pair)
            in_pair = np.diff(np.append(pair, len(docs)))
            ends = np.append(pair, len(docs))
            for bucket in range(buckets):
                lo, hi = bounds[bucket], bounds[bucket + 1]
                carries = batch_id % buckets == bucket
                if lo == hi and not carries:
                    continue
                pw, ph = w[pair[lo:hi]], h[pair[lo:hi]]
                first = _runs(pw) if hi > lo else np.zeros(0, np.int64)
                seen, index = np.unique(ph, return_inverse=True)
                a, b = (ends[lo], ends[hi]) if hi > lo else (0, 0)
                payload = _pack(
                    [
                        words[pw[first]],
                        np.diff(np.append(first, hi - lo)).astype("<u4"),
                        histories[seen],
                        index.astype("<u4"),
                        trained[lo:hi].astype("<u4"),
                        in_pair[lo:hi].astype("<u4"),
                        docs[a:b].astype("<u2"),
                        times[a:b].astype("<u4"),
                    ]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bucket], pa.int32()),
                        pa.array([batch_id << 16], pa.int64()),
                        pa.array([payload], pa.binary()),
                        pa.array([np.packbits(trains).tobytes()], pa.binary()),
                        pa.array([keys if carries else None], pa.list_(kind)),
                    ],
                    names=["bucket", "base", "payload", "train", "keys"],
                )

    key = rows.schema["key"].dataType.simpleString()
    kind = _arrow_type(rows, "key")
    return rows.mapInArrow(pack, f"bucket int, base long, payload binary, train binary, keys array<{key}>")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


# Kinds of rows in the stored tables.
_STATS, _DOC, _HISTORY, _UNSEEN, _KEY = range(5)
# Batches of a bucket whose documents are summed at a time.
_BATCHES = 16
_COUNTS = [f"c{r}" for r in range(1, CUTOFF + 2)]


def _count_bucket(
    rows: pa.Table, unigrams: Unigrams, hot: dict[int, int], start: int
) -> Iterator[dict[str, np.ndarray]]:
    """The partial sums of a bucket's bigrams."""
    ws, hs, trained, in_pair, docs, times = ([] for _ in range(6))
    for base, payload in zip(*(rows.column(c).to_pylist() for c in ("base", "payload")), strict=True):
        w, wn, hd, hi, tc, dn, di, dc = _unpack(payload)
        ws.append(np.repeat(w, wn))
        hs.append(hd[hi])
        trained.append(tc)
        in_pair.append(dn)
        docs.append(base + di.astype(np.int64))
        times.append(dc)
    w, h = np.concatenate(ws), np.concatenate(hs)
    ws.clear()
    hs.clear()
    if not len(w):
        return
    order = np.lexsort((h, w))
    begin = _runs(w[order], h[order])
    bigram = np.empty(len(w), dtype=np.int64)
    bigram[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(w))))
    count = np.add.reduceat(np.concatenate(trained)[order].astype(np.int64), begin)
    bw, bh = w[order][begin], h[order][begin]
    # The word's own count: of its bigrams here, or from the table of hot words.
    first = _runs(bw)
    words = bw[first]
    own = np.add.reduceat(count, first)
    for i, word in enumerate(words.tolist()):
        if word in hot:
            own[i] = hot[word]
    of_word = np.repeat(own, np.diff(np.append(first, len(bw))))
    uni = unigrams.probability(of_word)

    seen = count[count > 0]
    stats = np.bincount(np.minimum(seen, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
    yield {"kind": _STATS, "id": np.zeros(1, np.int64), **{c: stats[i : i + 1] for i, c in enumerate(_COUNTS)}}

    # Predecessors: what follows them in training.
    known = np.flatnonzero(count > 0)
    if len(known):
        known = known[np.argsort(bh[known], kind="stable")]
        begin = _runs(bh[known])
        sums = {c: np.add.reduceat((count[known] == i).astype(np.int64), begin) for i, c in enumerate(_COUNTS[:-1], 1)}
        yield {
            "kind": _HISTORY,
            "id": bh[known][begin].view(np.int64),
            "n": np.add.reduceat(count[known], begin),
            "x": np.add.reduceat(uni[known], begin),
            **sums,
        }

    # Documents. Each token takes its own count off for the token after it. A
    # document is in one batch only, so some batches at a time will do.
    at = 0
    for low in range(0, len(docs), _BATCHES):
        here = slice(low, low + _BATCHES)
        times_in = np.concatenate(in_pair[here])
        entry = np.repeat(bigram[at : at + len(times_in)], times_in)
        at += len(times_in)
        doc, m = np.concatenate(docs[here]), np.concatenate(times[here]).astype(np.int64)
        c, cw = count[entry], of_word[entry]
        score = np.where(c > 0, np.log10(np.maximum(c, 1)), np.log10(uni[entry]))
        ends = bw[entry] == np.uint64(END)
        score -= np.where(ends | (cw == 0), 0.0, np.log10(np.maximum(cw, 1)))
        score -= np.where(bh[entry] == np.uint64(START), np.log10(max(1, start)), 0.0)
        order = np.argsort(doc, kind="stable")
        begin = _runs(doc[order])

        def total(x: np.ndarray, order: np.ndarray = order, begin: np.ndarray = begin) -> np.ndarray:
            return np.add.reduceat(x[order], begin)

        yield {
            "kind": _DOC,
            "id": doc[order][begin],
            "n": total(m),
            "known": total(np.where(cw > 0, m, 0)),
            "x": total(m * np.log10(cw + 1.0)),
            "y": total(m * score),
            **{k: total(np.where(np.minimum(c, CUTOFF + 1) == i, m, 0)) for i, k in enumerate(_COUNTS, 1)},
        }
        unseen = np.flatnonzero(c == 0)
        if len(unseen):
            before, who, m = bh[entry[unseen]], doc[unseen], m[unseen]
            order = np.lexsort((who, before))
            begin = _runs(before[order], who[order])
            yield {
                "kind": _UNSEEN,
                "id": before[order][begin].view(np.int64),
                "doc": who[order][begin],
                "n": np.add.reduceat(m[order], begin),
            }


def ngram_tables(rows: DataFrame, words: DataFrame, buckets: int) -> tuple[DataFrame, Unigrams]:
    """The stored partial sums, by kind, and the unigram model. ``rows``: ``key,
    train, text``; ``words``: the stored :func:`count_words`."""
    spark = rows.sparkSession
    r = F.col("n_train")
    totals = words.agg(
        F.coalesce(F.sum("n_all"), F.lit(0)).alias("all"),
        F.coalesce(F.sum("n_train"), F.lit(0)).alias("train"),
        *[F.sum((r == i).cast("long")).alias(f"n{i}") for i in range(1, CUTOFF + 2)],
    ).first()
    unigrams = Unigrams(totals["train"], [totals[f"n{i}"] or 0 for i in range(1, CUTOFF + 2)])
    end = np.uint64(END).view(np.int64)
    often = words.where((F.col("n_all") * HOT_SHARE > totals["all"]) | (F.col("word") == int(end))).collect()
    hot = {int(np.int64(x["word"]).view(np.uint64)): x["n_train"] for x in often}
    start = hot.get(END, 0)
    packed = _bigrams(rows, np.array(list(hot), dtype=np.uint64), buckets)
    names = ["kind", "id", "doc", "n", "known", "x", "y", *_COUNTS]
    whole = {"x", "y"}

    @trimmed
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in sorted_groups(batches, ["bucket"]):
            named = (table.column(c).to_pylist() for c in ("base", "keys", "train"))
            for base, keys, train in zip(*named, strict=True):
                if keys is not None:
                    n = len(keys)
                    trains = np.unpackbits(np.frombuffer(train, np.uint8))[:n]
                    columns = {"id": pa.array(base + np.arange(n)), "known": pa.array(trains)}
                    yield record(_KEY, n, columns, pa.array(keys, kind))
            for part in _count_bucket(table, unigrams, hot, start):
                n = len(part["id"])
                columns = {k: pa.array(v) for k, v in part.items() if k != "kind"}
                yield record(part["kind"], n, columns, pa.nulls(n, kind))

    def record(what: int, n: int, columns: dict[str, pa.Array], keys: pa.Array) -> pa.RecordBatch:
        arrays = [
            pa.array(np.full(n, what, np.int8))
            if c == "kind"
            else columns[c].cast(pa.float64() if c in whole else pa.int64())
            if c in columns
            else pa.nulls(n, pa.float64() if c in whole else pa.int64())
            for c in names
        ]
        return pa.RecordBatch.from_arrays([*arrays, keys], names=[*names, "key"])

    kind = _arrow_type(rows, "key")
    types = {"kind": "tinyint"} | {c: "double" for c in whole}
    schema = ", ".join(f"{c} {types.get(c, 'long')}" for c in names)
    counted = (
        packed.repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(count, f"{schema}, key {rows.schema['key'].dataType.simpleString()}")
    )
    return materialize(counted, "ngrams"), unigrams


def backoff_weights(tables: DataFrame, rates: list[float]) -> DataFrame:
    """``id, weight``: log10 of a predecessor's count times its backoff weight."""
    kept = [F.col(f"s{r}") * (r * rates[r]) for r in range(1, CUTOFF + 1)]
    small = [F.col(f"s{r}") * r for r in range(1, CUTOFF + 1)]
    seen = sum(kept[1:], kept[0]) + (F.col("n") - sum(small[1:], small[0])) * rates[-1]
    return (
        tables.where(F.col("kind") == _HISTORY)
        .groupBy("id")
        .agg(F.sum("n").alias("n"), F.sum("x").alias("x"), *[F.sum(f"c{r}").alias(f"s{r}") for r in range(1, CUTOFF + 1)])
        .select("id", F.log10((F.col("n") - seen) / (1 - F.col("x"))).alias("weight"))
    )


def katz_scores(
    docs: DataFrame,
    train: Column,
    key: str = "doc_id",
    text: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of
    every row; rows for which ``train`` holds are learned from.

    ``buckets`` splits the n-gram tables (the shuffle partitions by default); one
    task holds one bucket.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), text_of(text).alias("text"))
    words = materialize(count_words(rows), "words")
    tables, unigrams = ngram_tables(rows, words, buckets)
    n_words = words.where("n_train > 0").count()
    stats = tables.where(F.col("kind") == _STATS).agg(*[F.sum(c).alias(c) for c in _COUNTS]).first()
    rates = Discounts([stats[c] or 0 for c in _COUNTS], unigrams.total).table().tolist()

    weights = backoff_weights(tables, rates)
    unseen = tables.where(F.col("kind") == _UNSEEN).select("id", "doc", "n")
    backed_off = unseen.join(weights, "id").select(
        F.col("doc").alias("id"), (F.col("n") * F.col("weight")).alias("y")
    )
    logs = np.log10(np.maximum(rates, np.finfo(float).tiny))
    by_count = [F.coalesce(F.col(c), F.lit(0)) * float(logs[i]) for i, c in enumerate(_COUNTS, 1)]
    named = F.col("kind") == _KEY
    own = tables.where(F.col("kind").isin(_DOC, _KEY)).select(
        "id",
        "key",
        F.when(named, F.col("known") == 0).alias("held_out"),
        "n",
        F.when(~named, F.col("known")).alias("known"),
        "x",
        (F.col("y") + sum(by_count[1:], by_count[0])).alias("y"),
    )
    scored = (
        own.unionByName(backed_off, allowMissingColumns=True)
        .groupBy("id")
        .agg(
            F.max("key").alias("key"),
            F.max("held_out").alias("held_out"),
            F.sum("n").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.sum("x").alias("x"),
            F.sum("y").alias("score"),
        )
    )
    size = unigrams.total + n_words + 1
    return scored.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(unigrams.total).cast("long").alias("train_tokens"),
        (F.col("x") - F.col("n_tokens") * float(np.log10(size))).alias("base_score"),
        "score",
    )
