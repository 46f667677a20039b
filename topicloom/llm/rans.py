"""Token ids in compressed blocks: static range asymmetric numeral system.

One table of symbol frequencies, counted over the whole corpus and scaled to
``2**PRECISION``, is shared by all blocks. A block holds whole documents. Its
tokens are dealt in turn to ``LANES`` interleaved coders, whose states advance
together as one numpy vector. Every ``CHECKPOINT`` steps the states and the place
in the stream are recorded, so a reader may begin there: the segments between
checkpoints are decoded side by side. Blocks depend on nothing but the table.

The file format is a folder with two Parquet tables, ``frequencies`` (token,
freq) and ``blocks`` (part, block, part_start, n_tokens, keys, payload). Spark's
committer makes writing safe when executors are lost, and any store Spark can
write to will do. A payload is, little-endian: ``HEADER``; the documents' token
counts (uint32); the states (uint64) and stream places (uint32) of each
checkpoint, the first being the block's beginning; the stream of 32-bit words.
The header holds two crc32 sums: of the token ids as uint32, and of all that
follows it.

Null texts are empty: their end token is all they have. Rows that repeat a key
are documents of their own, in the order of their ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import ddl, text_of, trimmed
from topicloom.llm.tokens import id_encoder, load
from topicloom.session import materialize

PRECISION = 20
LANES = 512
CHECKPOINT = 128
# A block is closed when it has so many tokens.
BLOCK_TOKENS = 1 << 18

HEADER = struct.Struct("<4sHHIIIIII")  # magic, lanes, precision, tokens, docs, segments, words, two sums
MAGIC = b"TLR1"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Scaled frequencies with what encoding and decoding need."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray):
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.freq = np.zeros(size, dtype=np.uint64)
        self.freq[tokens] = freqs
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        """The symbol of every slot."""
        if self._symbols is None:
            self._symbols = np.repeat(
                np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64)
            )
        return self._symbols


def scale(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that add up to ``2**precision``; a symbol that occurs keeps 1
    at least. Ties go by position."""
    total, slots = int(counts.sum()), 1 << precision
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    if np.count_nonzero(counts) > slots:
        raise ValueError(f"more symbols than 2**{precision} slots")
    exact = counts.astype(np.float64) * slots / total
    freqs = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    short = slots - int(freqs.sum())
    if short > 0:
        freqs[np.argmax(counts)] += short
    while short < 0:  # many rare symbols were raised to 1: the large ones pay
        order = np.argsort(-freqs, kind="stable")
        room = freqs[order] - 1
        take = np.minimum(room, np.maximum(1, room * -short // max(1, int(room.sum()))))
        kept = np.cumsum(take)
        take = np.where(kept <= -short, take, np.maximum(0, take - (kept + short)))
        take = np.minimum(take, room)
        freqs[order] -= take
        short += int(take.sum())
    return freqs


def encode_block(lengths: list[int], tokens: np.ndarray, table: Table) -> bytes:
    """A payload of the documents' tokens, one after the other."""
    n = len(tokens)
    steps = -(-n // LANES)
    freq = table.freq[tokens]
    if n and not freq.all():
        raise ValueError("a token is missing from the frequency table")
    cum = table.cum[tokens]
    limit = freq << np.uint64(63 - PRECISION)
    state = np.full(LANES, _LOW, dtype=np.uint64)
    shift = np.uint64(PRECISION)
    words: list[np.ndarray] = []
    count = 0
    marks: list[tuple[np.ndarray, int]] = []
    for step in range(steps - 1, -1, -1):
        lo, hi = step * LANES, min(n, (step + 1) * LANES)
        x, f = state[: hi - lo], freq[lo:hi]
        full = x >= limit[lo:hi]
        if full.any():
            out = x[full].astype(np.uint32)
            words.append(out[::-1])
            count += len(out)
            x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: hi - lo] = (q << shift) + (x - q * f) + cum[lo:hi]
        if step % CHECKPOINT == 0:
            marks.append((state.copy(), count))
    marks.reverse()
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    body = b"".join(
        [
            np.asarray(lengths, dtype="<u4").tobytes(),
            *(s.astype("<u8").tobytes() for s, _ in marks),
            np.array([count - c for _, c in marks], dtype="<u4").tobytes(),
            stream.astype("<u4").tobytes(),
        ]
    )
    sums = zlib.crc32(tokens.astype("<u4").tobytes()), zlib.crc32(body)
    return HEADER.pack(MAGIC, LANES, PRECISION, n, len(lengths), len(marks), count, *sums) + body


def _decode_segments(
    state: np.ndarray, place: np.ndarray, words: np.ndarray, steps: int, table: Table
) -> np.ndarray:
    """Tokens of equally long segments, ``(segments, steps, lanes)``."""
    segments, lanes = state.shape
    out = np.empty((steps, segments, lanes), dtype=np.uint32)
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    symbols, freq, cum = table.symbols, table.freq, table.cum
    place = place.astype(np.int64)
    for step in range(steps):
        slot = state & mask
        symbol = symbols[slot]
        out[step] = symbol
        state = freq[symbol] * (state >> shift) + slot - cum[symbol]
        low = state < _LOW
        taken = low.sum(axis=1)
        if taken.any():
            at = place[:, None] + np.cumsum(low, axis=1) - 1
            state[low] = (state[low] << _WORD) | words[at[low]]
            place = place + taken
    return out.swapaxes(0, 1)


def decode_block(payload: bytes, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Document lengths and all tokens of a payload; checks both sums."""
    magic, lanes, precision, n, docs, segments, n_words, ids_sum, body_sum = HEADER.unpack_from(payload)
    if magic != MAGIC or precision != PRECISION:
        raise ValueError("not a block of this format")
    if zlib.crc32(payload[HEADER.size :]) != body_sum:
        raise ValueError("damaged block: the checksum of its bytes is wrong")
    at = HEADER.size
    lengths = np.frombuffer(payload, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    states = np.frombuffer(payload, "<u8", segments * lanes, at).reshape(segments, lanes).astype(np.uint64)
    at += 8 * segments * lanes
    places = np.frombuffer(payload, "<u4", segments, at)
    words = np.frombuffer(payload, "<u4", n_words, at + 4 * segments).astype(np.uint64)
    span = CHECKPOINT * lanes
    whole = n // span
    parts = []
    if whole:
        parts.append(_decode_segments(states[:whole], places[:whole], words, CHECKPOINT, table).ravel())
    rest = n - whole * span
    if rest:
        full, odd = divmod(rest, lanes)
        tail = _decode_segments_rest(states[whole], int(places[whole]), words, full, odd, table)
        parts.append(tail)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if zlib.crc32(tokens.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("damaged block: the checksum of its tokens is wrong")
    return lengths, tokens


def _decode_segments_rest(
    state: np.ndarray, place: int, words: np.ndarray, full: int, odd: int, table: Table
) -> np.ndarray:
    """The last segment, which may end amid a step."""
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    out = []
    for step in range(full + bool(odd)):
        x = state if step < full else state[:odd]
        slot = x & mask
        symbol = table.symbols[slot]
        out.append(symbol)
        x = table.freq[symbol] * (x >> shift) + slot - table.cum[symbol]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _WORD) | words[place : place + len(low)]
        place += len(low)
        state = x
    return np.concatenate(out)


# ------------------------------------------------------------------ Spark jobs


def encode_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, ids``: token ids plus ``end_id``, as little-endian uint16 if the
    vocabulary allows, else uint32 (``width`` says which)."""

    @trimmed
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if load(tokenizer).get_vocab_size() <= 1 << 16 else 4
        encoder = id_encoder(tokenizer, width)
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            ids = [e + end for e in encoder.encode_all(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                names=[key, "width", "ids"],
            )

    return docs.select(key, text_of(text).alias("text")).mapInArrow(
        encode, f"{ddl(docs, key)}, width int, ids binary"
    )


def token_frequencies(encoded: DataFrame) -> DataFrame:
    """``token, n`` over all documents, summed in the tasks first."""

    @trimmed
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for width in pc.unique(batch.column(0)).to_pylist():
                ids = b"".join(batch.column(1).filter(pc.equal(batch.column(0), width)).to_pylist())
                found = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(found) > len(totals):
                    totals = np.pad(totals, (0, len(found) - len(totals)))
                totals[: len(found)] += found
        tokens = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.int64()), pa.array(totals[tokens], pa.int64())], names=["token", "n"]
        )

    counted = encoded.select("width", "ids").mapInArrow(count, "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Writes all documents to ``path``, in ascending order of ``key``."""
    spark = docs.sparkSession
    encoded = materialize(encode_documents(docs, tokenizer, end_id, key, text), "token-ids")
    # One row per vocabulary entry at most.
    rows = token_frequencies(encoded).orderBy("token").collect()
    tokens = np.array([r["token"] for r in rows], dtype=np.int64)
    freqs = scale(np.array([r["n"] for r in rows], dtype=np.int64))
    spark.createDataFrame(
        [(int(t), int(f)) for t, f in zip(tokens, freqs, strict=True)], "token long, freq long"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast((tokens, freqs))

    @trimmed
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        part = TaskContext.get().partitionId()
        block = start = held = 0
        keys: list[pa.Array] = []
        arrays: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            payload = encode_block([len(a) for a in arrays], np.concatenate(arrays), table)
            values = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int64()),
                    pa.array([start], pa.int64()),
                    pa.array([held], pa.int64()),
                    lists,
                    pa.array([payload], pa.binary()),
                ],
                names=["part", "block", "part_start", "n_tokens", "keys", "payload"],
            )

        for batch in batches:
            widths, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            first = 0
            for i, (width, data) in enumerate(zip(widths, ids, strict=True)):
                arrays.append(np.frombuffer(data, f"<u{width}").astype(np.int64))
                held += len(arrays[-1])
                if held >= block_tokens:
                    keys.append(batch.column(0).slice(first, i + 1 - first))
                    yield close()
                    first, block, start, held = i + 1, block + 1, start + held, 0
                    keys.clear()
                    arrays.clear()
            if first < batch.num_rows:
                keys.append(batch.column(0).slice(first))
        if arrays:
            yield close()

    kind = docs.schema[key].dataType.simpleString()
    blocks = (
        encoded.repartitionByRange(key)
        .sortWithinPartitions(key, "ids")
        .mapInArrow(
            encode,
            f"part int, block long, part_start long, n_tokens long, keys array<{kind}>, payload binary",
        )
    )
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of the files at ``path``: ``key, start, n_tokens, ids_crc32`` and,
    with ``with_ids``, ``ids`` (little-endian uint32). ``start`` counts the tokens
    of all documents before. Every block is decoded by itself and checked."""
    rows = spark.read.parquet(f"{path}/frequencies").orderBy("token").collect()
    shared = spark.sparkContext.broadcast(
        (
            np.array([r["token"] for r in rows], dtype=np.int64),
            np.array([r["freq"] for r in rows], dtype=np.int64),
        )
    )
    blocks = spark.read.parquet(f"{path}/blocks")

    @trimmed
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            parts, starts, keys, payloads = batch.columns
            for i in range(batch.num_rows):
                lengths, tokens = decode_block(payloads[i].as_py(), table)
                data = tokens.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                pieces = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array([parts[i].as_py()] * len(lengths), pa.int32()),
                    keys[i].values,
                    pa.array(starts[i].as_py() + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    *([pa.array(pieces, pa.binary())] if with_ids else []),
                ]
                names = ["part", key, "in_part", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    schema = f"part int, `{key}` {kind}, in_part long, n_tokens long, ids_crc32 long"
    decoded = blocks.select("part", "part_start", "keys", "payload").mapInArrow(
        decode, schema + (", ids binary" if with_ids else "")
    )
    # One row per written file: the tokens in the files before it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocks.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return decoded.join(bases, "part").select(
        key, (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
