"""Packing of documents into sequences of at most ``max_len`` tokens.

Shortest-pack-first over the length histogram. Documents are cut into pieces of
at most ``max_len`` tokens; only the histogram of piece lengths, which has
``max_len`` entries at most, goes to the driver. There the lengths are placed
longest first, each into the packs that are filled least so far, and what is
kept are patterns (the lengths of a pack) with counts. The patterns then say for
every length which ranks go to which sequence and offset, and pieces are joined
to that table by their rank among the pieces of their length.

Null texts are empty; an empty document is its end token alone. Rows that repeat
a key are packed like any other rows. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from topicloom.llm.common import ddl, text_of, trimmed
from topicloom.llm.tokens import CAPACITY, id_encoder
from topicloom.session import materialize

MAX_LEN = 1024
# Pieces of one length are numbered in so many parts, so that a length that a
# large part of the pieces has is not numbered by one task.
RANK_PARTS = 256


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    max_len: int = MAX_LEN,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    remembered: int = CAPACITY,
) -> DataFrame:
    """Documents as token ids plus ``end_id``, cut every ``max_len`` tokens:
    ``key, start, length, ids_crc32, doc_tokens`` and, with ``with_ids``, ``ids``
    (little-endian unsigned 32-bit)."""

    @trimmed
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer, capacity=remembered)
        end = end_id.to_bytes(4, "little")
        step = 4 * max_len
        for batch in batches:
            rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for i, encoded in enumerate(encoder.encode_all(batch.column(1))):
                data = encoded + end
                for at in range(0, len(data), step):
                    piece = data[at : at + step]
                    rows.append(i)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(data) // 4)
                    if with_ids:
                        ids.append(piece)
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)),
                *([pa.array(ids, pa.binary())] if with_ids else []),
            ]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    schema = f"{ddl(docs, key)}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(key, text_of(text).alias("text")).mapInArrow(
        cut, schema + (", ids binary" if with_ids else "")
    )


def shortest_pack_first(
    histogram: dict[int, int], max_len: int = MAX_LEN
) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns with counts. A pattern is a run of ``(length, times)``.

    Its work depends on the number of different lengths and on ``max_len``, not
    on the number of pieces.
    """
    open_packs: dict[int, list[tuple[tuple, int]]] = {}
    spaces: list[int] = []  # largest first, negated
    done: list[tuple[tuple, int]] = []

    def put(space: int, pattern: tuple, count: int) -> None:
        if space == 0:
            done.append((pattern, count))
            return
        if space not in open_packs:
            open_packs[space] = []
            heapq.heappush(spaces, -space)
        open_packs[space].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while spaces and not open_packs.get(-spaces[0]):
                open_packs.pop(-heapq.heappop(spaces), None)
            space = -spaces[0] if spaces else 0
            if space < length:  # the least filled pack has no room
                put(max_len - length, ((length, 1),), left)
                break
            pattern, count = open_packs[space].pop()
            used = min(count, left)
            if count > used:
                open_packs[space].append((pattern, count - used))
            head, (last, times) = pattern[:-1], pattern[-1]
            grown = (*head, (last, times + 1)) if last == length else (*pattern, (length, 1))
            put(space - length, grown, used)
            left -= used
    for held in open_packs.values():
        done.extend(held)
    return done


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, ...]]:
    """Where the pieces of a length go, by rank: rows ``(length, low, high,
    times, first_sequence, offset, used)``. A pattern that has the length
    ``times`` times takes ``times`` ranks for each of its sequences."""
    out = []
    next_rank: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        used = sum(length * times for length, times in pattern)
        offset = 0
        for length, times in pattern:
            low = next_rank.get(length, 0)
            next_rank[length] = low + count * times
            out.append((length, low, low + count * times, times, sequence, offset, used))
            offset += length * times
        sequence += count
    return out


_SLOT = T.StructType(
    [
        T.StructField(n, T.LongType())
        for n in ("slot_length", "low", "high", "times", "first_sequence", "first_offset", "used")
    ]
)


def _ranked(table: DataFrame, key: str) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0 on without gaps."""
    parted = table.withColumn(
        "rank_part", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(RANK_PARTS)).cast("int")
    )
    counts = parted.groupBy("length", "rank_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "length", "rank_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length", "rank_part").orderBy(key, "start", "ids_crc32")
    return (
        parted.withColumn("place", F.row_number().over(within) - 1)
        .join(bases, ["length", "rank_part"])
        .withColumn("rank", F.col("base") + F.col("place"))
        .drop("rank_part", "place", "base")
    )


def pack(table: DataFrame, max_len: int = MAX_LEN, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id``, ``offset``, ``sequence_tokens`` and ``padded_to`` to a
    stored table of pieces (:func:`pieces`).

    ``padded_to`` is ``max_len``, or the number of tokens itself when that is a
    power of two.
    """
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = table.sparkSession.createDataFrame(slots(shortest_pack_first(histogram, max_len)), _SLOT)
    at = F.col("rank") - F.col("low")
    # The plan's size is bounded by max_len, whatever the number of pieces.
    placed = _ranked(table, key).join(
        F.broadcast(plan),
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("low"))
        & (F.col("rank") < F.col("high")),
    )
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return (
        placed.withColumn("sequence_id", F.col("first_sequence") + F.floor(at / F.col("times")).cast("long"))
        .withColumn("offset", F.col("first_offset") + (at % F.col("times")) * F.col("length"))
        .withColumn("sequence_tokens", F.col("used"))
        .withColumn("padded_to", F.when(power, F.col("used")).otherwise(F.lit(max_len).cast("long")))
        .select(
            *(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to"),
            *(["ids"] if "ids" in table.columns else []),
        )
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    max_len: int = MAX_LEN,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    remembered: int = CAPACITY,
) -> DataFrame:
    """:func:`pieces`, stored once, then :func:`pack`. ``remembered`` trades a
    worker's memory for time; the result is the same."""
    cut = pieces(docs, tokenizer, end_id, max_len, key, text, with_ids, remembered)
    return pack(materialize(cut, "pieces"), max_len, key)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, padded_to, ids`` (the pieces' bytes
    in order) from a packing made with ``with_ids``. A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.first("padded_to").alias("padded_to"), joined.alias("ids"))
