"""N-gram Jaccard join: documents whose word n-gram sets are alike.

MinHash banding: bands and rows are chosen so that a pair at the threshold
collides in some band with the wanted recall. Documents with the same n-gram set
form a class, of which only the smallest key goes on, so copies cost nothing.
Band hashes are shuffled, and each member of a bucket is linked to the bucket's
smallest member only; what is connected that way is a set of candidates. Within a
candidate set all pairs are verified on the full n-gram sets, which finds at
least the pairs that share a band. Large candidate sets are cut into blocks and
verified by pairs of blocks; a task gives counts per document and a spanning
forest of its links, never the pairs.

Words are lower-cased runs of letters, digits and non-ASCII characters. A text of
fewer words than ``size`` has one n-gram, all its words; null texts and texts
without words have none and are linked to nothing. Rows that repeat a key are
judged by their own texts; rows with equal texts are copies of each other. Rows
without a key are linked to nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import (
    WordHashes,
    byte_column,
    ddl,
    mix,
    plain_words,
    shingle_hashes,
    slices,
    sorted_groups,
    text_of,
    trimmed,
)
from topicloom.session import materialize

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
# Documents in a block of a large candidate set.
BLOCK = 256
# Distinct n-grams that are compared at a time.
COLUMNS = 16_384


def choose_bands(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows per band: as many rows as ``most`` hashes allow with the
    wanted recall at the threshold."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding reaches that recall with so few hashes")
    return best


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minimum of each hash over the set."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024, None] * seeds[None, :]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum(low, part.min(axis=0))
    return low


def band_hashes(low: np.ndarray, bands: int, rows: int) -> list[int]:
    table = mix(low.reshape(bands, rows) + np.arange(rows, dtype=np.uint64))
    total = np.zeros(bands, dtype=np.uint64)
    for i in range(rows):
        total = mix(total + table[:, i])
    return (total + np.arange(bands, dtype=np.uint64)).view(np.int64).tolist()


def _seeds(count: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"minhash", seed=i) | 1 for i in range(count)], np.uint64)


def _sets(texts: Iterable[bytes], hashes: WordHashes, size: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield np.unique(shingle_hashes(hashes.of(plain_words(text)), size))


def sketches(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """``key, set_id, bands`` of each row; ``set_id`` is a 128-bit hash of the set,
    null without n-grams."""

    @trimmed
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seeds = WordHashes(), _seeds(bands * rows)
        for batch in slices(batches):
            ids, lists = [], []
            for found in _sets(byte_column(batch, "text"), hashes, size):
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                lists.append(band_hashes(signature(found, seeds), bands, rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                names=[key, "set_id", "bands"],
            )

    return docs.select(key, text_of(text).alias("text")).mapInArrow(
        sketch, f"{ddl(docs, key)}, set_id binary, bands array<long>"
    )


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root``: each node of an undirected graph (``a, b``) with the smallest
    node it is connected to. Nodes link to ever smaller ones, from both ends of an
    edge in turn, until every component is a star; the number of rounds grows with
    the logarithm of the component's size."""

    def oriented(table: DataFrame) -> DataFrame:
        return table.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    state = materialize(oriented(edges), name)
    before = None
    while True:
        # Every neighbour above a node goes to the smallest one around the node.
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = oriented(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        # Then a node and those below it go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        state = materialize(oriented(small.unionByName(least.select("a", F.col("low").alias("b")))), name)
        now = state.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if now == before:
            break
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share. Those in one set only are left out;
    the rest are compared as 0/1 matrices, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, column = owner[keep], number[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - low)), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        total += (block @ block.T).astype(np.int64)
    return total


def links_between(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs at or above the threshold; with ``split``, only
    of pairs with one member before that place and one from it on."""
    sizes = np.array([len(s) for s in sets])
    both = _intersections(sets)
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if split:
        linked[:split, :split] = False
        linked[split:, split:] = False
    return linked


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the matrix connects: each node with the one it was
    reached from."""
    seen = np.zeros(len(linked), dtype=bool)
    out = []
    for start in range(len(linked)):
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            node = todo.pop()
            new = np.flatnonzero(linked[node] & ~seen)
            seen[new] = True
            out.extend((node, x) for x in new.tolist())
            todo.extend(new.tolist())
    return out


def _verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """``a, b, links``: per class its links to other classes, counted in documents
    (``b`` null), and edges of the forests (``links`` null)."""

    @trimmed
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in sorted_groups(batches, ["root", "i", "j"]):
            names, sizes, sides, sets = (rows.column(c).to_pylist() for c in ("node", "size", "side", "shingles"))
            # Rows that repeat a document bring its set more than once.
            first = {n: k for k, n in reversed(list(enumerate(names)))}
            order = sorted(first.values(), key=lambda k: (sides[k], k))
            if len(order) < 2:
                continue
            split = sum(sides[k] == 0 for k in order) if i != j else 0
            linked = links_between([np.frombuffer(sets[k], np.uint64) for k in order], split, threshold)
            counts = (linked @ np.array([sizes[k] for k in order])).tolist()
            hit = [k for k, c in enumerate(counts) if c]
            edges = _forest(linked)
            name = [names[k] for k in order]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name[k] for k in hit] + [name[a] for a, _ in edges], pa.binary()),
                    pa.array([None] * len(hit) + [name[b] for _, b in edges], pa.binary()),
                    pa.array([counts[k] for k in hit] + [None] * len(edges), pa.int64()),
                ],
                names=["a", "b", "links"],
            )

    return blocks.mapInArrow(verify, "a binary, b binary, links long")


def jaccard_join(
    docs: DataFrame,
    size: int = SIZE,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    key: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """``key, class_id, group_id, n_links`` of every row: the smallest key among
    the rows with the same n-grams, the smallest key that links lead to, and the
    number of other rows at or above the threshold."""
    bands, rows = choose_bands(threshold, recall)
    sketched = materialize(sketches(docs, key, text, size, bands, rows), "sketches")
    classes = materialize(
        sketched.where(F.col("set_id").isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col("set_id").alias("node"))
        .agg(F.min(key).alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    candidates = banded.join(buckets, "band").select(F.col("node").alias("a"), "b").where("a <> b")
    members = _with_roots(connected(candidates, "candidates"))
    blocks = _blocks(docs, classes.drop("bands"), members, size, key, text, block)
    found = materialize(_verified(blocks, threshold), "links")

    groups = _with_roots(connected(found.where("b is not null").select("a", "b"), "groups"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = groups.join(classes.select("node", "rep"), "node")
    smallest = named.groupBy("root").agg(F.min("rep").alias("group_id"))
    judged = (
        classes.select("node", "rep", "size")
        .join(links, "node", "left")
        .join(named.join(smallest, "root").select("node", "group_id"), "node", "left")
    )
    return (
        sketched.select(key, F.col("set_id").alias("node"))
        .join(judged, "node", "left")
        .select(
            key,
            F.coalesce("rep", key).alias("class_id"),
            F.coalesce("group_id", "rep", key).alias("group_id"),
            F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        )
    )


def _with_roots(stars: DataFrame) -> DataFrame:
    """Every member of a component with its root, the root itself included."""
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _blocks(
    docs: DataFrame, classes: DataFrame, members: DataFrame, size: int, key: str, text: str, block: int
) -> DataFrame:
    """Members of candidate sets with their n-grams, one row for each pair of
    blocks ``(i, j)`` they take part in, sorted by that pair within partitions."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").select(
        "node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    )
    wanted = placed.join(classes, "node")
    names = ["node", "root", "blocks", "own", "size"]

    @trimmed
    def shingle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            # Rows that repeat the key may have other texts.
            nodes, sets, rows = batch.column("node").to_pylist(), [], []
            for i, found in enumerate(_sets(byte_column(batch, "text"), hashes, size)):
                if xxhash.xxh3_128_digest(found.tobytes()) == nodes[i]:
                    rows.append(i)
                    sets.append(found.tobytes())
            kept = batch.select(names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], names=[*names, "shingles"])

    sets = (
        docs.select(F.col(key).alias("rep"), text_of(text).alias("text"))
        .join(wanted, "rep")
        .select(*names, "text")
        .mapInArrow(shingle, "node binary, root binary, blocks int, own int, size long, shingles binary")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return (
        sets.select("node", "root", "own", "size", "shingles", other)
        .select(
            "node",
            "root",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "size",
            "shingles",
        )
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
    )


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest
    key stays. Rows that share a key stay if one of them does; rows without a key
    stay."""
    joined = jaccard_join(docs, key=key, text=text, **options)
    stays = F.max((F.col("group_id") == F.col(key)).cast("int"))
    dropped = joined.groupBy(key).agg(stays.alias("stays")).where("stays = 0").select(key)
    return docs.join(dropped, key, "left_anti").select(docs.columns)
