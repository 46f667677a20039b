"""Benchmark decontamination by a generalised suffix automaton.

The automaton is built over the words of all test items. A document's words run
through it once, and the length of the longest run of words ending at each
position that occurs in some item is tracked. Wherever that length reaches
``window`` words, the words of the run are hit and the items that hold its last
``window`` words are noted. An item of fewer words is hit as a whole.

Automata are built for blocks of at most ``BLOCK_WORDS`` item words, which bounds
what is broadcast; items longer than a piece are cut into pieces that overlap by
``window - 1`` words, so no window is lost. Documents pass the blocks in turn.

Words are lower-cased runs of letters, digits and non-ASCII characters. Null and
empty texts have no words, on either side. A null item id counts as the empty
id. Items that repeat an id count once. Columns of the documents are kept, of
whatever name. With no items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import plain_words, text_of, trimmed
from topicloom.session import materialize

WINDOW = 10
BLOCK_WORDS = 200_000
PIECE_WORDS = 4_096
# A document with more than this share of its words hit is dropped as a whole;
# else its spans are cut out.
MAX_COVERAGE = 0.5

_FOUND = "struct<n_words:long,spans:array<struct<start:long,stop:long>>,items:array<string>>"
_FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((name, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        # The shortest run of words that can be a hit.
        self.least = min((min(window, len(ids)) for _, ids in coded if ids), default=window)
        self._note(coded)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's longest run followed by c; a copy of q if need be."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def _note(self, coded: list[tuple[str, list[int]]]) -> None:
        """``holder[v]``: the state of the last ``window`` words of v's runs;
        ``items[u]``: the items with that window; ``whole[v]``: short items that
        end wherever v does, with the run length they need."""
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.holder = [-1] * len(self.next)
        for v in order:
            if self.length[v] >= self.window:
                up = self.link[v]
                self.holder[v] = v if self.length[up] < self.window else self.holder[up]
        self.items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, ids in coded:
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if i + 1 >= self.window:
                    self.items.setdefault(self.holder[v], set()).add(name)
            if 0 < len(ids) < self.window:
                short.setdefault(v, []).append((len(ids), name))
        self.whole: list[list[tuple[int, str]] | None] = [None] * len(self.next)
        if short:
            for v in order[1:]:
                found = short.get(v, []) + (self.whole[self.link[v]] or [])
                self.whole[v] = found or None

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (merged, stop exclusive) and items of a document."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        # A run without a word of any item lies outside every match.
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start >= self.least:
                self._run(ids[start:stop].tolist(), start, spans, names)
        return spans, names

    def _run(self, ids: list[int], start: int, spans: list[tuple[int, int]], names: set[str]) -> None:
        following, link, length, whole = self.next, self.link, self.length, self.whole
        window = self.window
        v = matched = 0
        holders = set()
        for i, c in enumerate(ids, start):
            target = following[v].get(c)
            while target is None and v:
                v = link[v]
                matched = length[v]
                target = following[v].get(c)
            if target is None:
                continue
            v, matched = target, matched + 1
            reach = 0
            if matched >= window:
                reach = matched
                holders.add(self.holder[v])
            if whole[v]:
                for need, name in whole[v]:
                    if matched >= need:
                        reach = max(reach, need)
                        names.add(name)
            if reach:
                low = i + 1 - reach
                while spans and spans[-1][1] >= low:
                    low = min(low, spans.pop()[0])
                spans.append((low, i + 1))
        for u in holders:
            names |= self.items.get(u, set())


def item_pieces(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``item, words (joined by spaces), n``: items in pieces of bounded length."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts, counts = [], [], []
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = plain_words(value.encode())
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    part = words[at : at + PIECE_WORDS + window - 1]
                    if part:
                        names.append(name)
                        parts.append(b" ".join(part).decode())
                        counts.append(len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(parts, pa.string()), pa.array(counts, pa.int64())],
                names=["item", "words", "n"],
            )

    named = F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item")
    return benchmark.select(named, text_of(text).alias("text")).mapInArrow(
        cut, "item string, words string, n long"
    )


def _scanner(automaton) -> Column:
    @F.arrow_udf(_FOUND)
    @trimmed
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = automaton.value
        for values in texts:
            out = []
            parts = (values.slice(at, 500).to_pylist() for at in range(0, len(values), 500))
            for value in (v for part in parts for v in part):
                words = plain_words(value.encode())
                spans, names = found.scan(words)
                out.append(
                    {
                        "n_words": len(words),
                        "spans": [{"start": a, "stop": b} for a, b in spans],
                        "items": sorted(names),
                    }
                )
            yield pa.array(out, _FOUND_ARROW)

    return scan("scan_text")


def _merge_lists(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in lists:
        out = []
        for spans in values.to_pylist():
            merged: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
                if merged and merged[-1]["stop"] >= s["start"]:
                    merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                else:
                    merged.append(s)
            out.append(merged)
        yield pa.array(out, _FOUND_ARROW.field("spans").type)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Each document as ``row`` (all its columns), ``scan_text``, and ``found``:
    ``n_words``, hit ``spans`` of words and the ids of the ``items`` hit, sorted as
    strings."""
    spark = docs.sparkSession
    pieces = materialize(item_pieces(benchmark, item, item_text, window), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    merge = F.arrow_udf(_merge_lists, "array<struct<start:long,stop:long>>")
    out = docs.select(F.struct("*").alias("row"), text_of(text).alias("scan_text"))
    for b in range(blocks):
        rows = pieces.where(block == b).orderBy("item", "words").collect()
        automaton = spark.sparkContext.broadcast(
            Automaton([(r["item"], r["words"].encode().split()) for r in rows], window)
        )
        found = _scanner(automaton)
        if b == 0:
            out = out.withColumn("found", found)
            continue
        # Stored in between, so that a worker holds one automaton at a time.
        out = materialize(out, "scanned").withColumn("more", found)
        out = out.withColumn(
            "found",
            F.struct(
                "found.n_words",
                merge(F.concat("found.spans", "more.spans")).alias("spans"),
                F.array_sort(F.array_union("found.items", "more.items")).alias("items"),
            ),
        ).drop("more")
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words. What separates a span from the
    next word goes with it, but for line breaks."""
    data = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(data)]
    out, at = [], 0
    for start, stop in spans:
        out.append(data[at : places[start][0]])
        at = places[stop][0] if stop < len(places) else len(data)
        if b"\n" in data[places[stop - 1][1] : at]:
            out.append(b"\n")
    out.append(data[at:])
    return b"".join(out).decode()


@trimmed
def _cut_out_lists(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for values, spans in texts:
        yield pa.array(
            [
                without_spans(t, [(s["start"], s["stop"]) for s in cut]) if cut else t
                for t, cut in zip(values.to_pylist(), spans.to_pylist(), strict=True)
            ],
            pa.string(),
        )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_span: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    text: str = "text",
    **names: str,
) -> DataFrame:
    """The documents, cleaned: hit spans of ``min_span`` words or more are cut out,
    and those of fewer than ``window`` words, which are whole items, whatever their
    length; a document with more than ``max_coverage`` of
    its words hit is left out. Documents without a hit stay as they are."""
    scanned = overlaps(docs, benchmark, window, text, **names)
    size = lambda s: s["stop"] - s["start"]
    cut = F.filter("found.spans", lambda s: (size(s) >= min_span) | (size(s) < window))
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    kept = scanned.where(hit <= F.lit(max_coverage) * F.col("found.n_words"))
    cut_out = F.arrow_udf(_cut_out_lists, "string")
    cleaned = F.when(F.size(cut) == 0, F.col(f"row.`{text}`")).otherwise(cut_out("scan_text", cut))
    columns = [cleaned.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return kept.select(*columns)
