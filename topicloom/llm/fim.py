"""Fill-in-middle transformation of documents.

Method: secondary-sort assembly. A text is cut into units (white space with the
word after it, or white space at the end); two cut points in units, drawn from
the sha256 of the seed and the key, make prefix, middle and suffix, and the form
(plain, psm or spm) says their order in the output with the sentinels between
them. Each row is then emitted as pieces of at most ``PIECE`` code points, keyed
by the row and its output position (segment, start); sentinels are pieces of
their own. Pieces are sorted within partitions by that key and a Python task
streams them into an incremental sha256 per row, holding one batch of pieces and
not the text. For the restoration the output is read back: each content piece
takes the role of the last sentinel before it (a running window over the output
order), pieces are sorted again by role (prefix, middle, suffix) and output
position, and streamed into a second digest.

The one shuffle is the grouping of equal rows (key, xxhash64 of the text and its
length), which combines copies on the map side, so a row repeated a third of all
rows is one row after it; the pieces are cut after it and keep its partitioning,
so the sorts need no further exchange. The digest of one text is sequential by
nature: one task streams a very long text, in bounded memory.

Definitions: a null text is empty. An empty text, or one that holds ``<P>``,
``<S>`` or ``<M>``, is plain. A null key is seeded by ``42:`` alone.
``prefix_chars`` and ``middle_chars`` are null for plain rows. Repeated rows each
give their row, with the same values. Only the key and the text are read, so
other columns never clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import ddl, text_of, trimmed

# Fixed values of the transformation.
SEED = "42"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_RATE, SPM_RATE = 50, 80  # percent

# Code points of a piece.
PIECE = 1 << 16
_ID = ["key", "h", "len"]
# What each piece carries of its row, so that one exchange feeds every branch.
_INFO = ["copies", "n", "form", "a", "b"]


def _group(digest: str, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """Distinct rows with their cut: ``key, h, len, copies, text, n, form, a, b``
    (a and b in code points, b - a the middle)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))
    distinct = rows.groupBy(
        "key", F.xxhash64("text").alias("h"), F.char_length("text").alias("len")
    ).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    units = F.regexp_extract_all("text", F.lit(UNIT), 0)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    with_units = distinct.select(
        *_ID, "copies", "text", units.alias("units"), digest.alias("digest")
    ).withColumn("n", F.size("units").cast("long"))
    cuts = [F.pmod(_group("digest", i), F.col("n") + 1) for i in (0, 1)]

    def chars(count: Column) -> Column:
        return F.aggregate(
            F.slice("units", 1, count.cast("int")), F.lit(0).cast("long"), lambda acc, u: acc + F.char_length(u)
        )

    plain = (
        (F.col("len") == 0)
        | F.col("text").contains(PREFIX)
        | F.col("text").contains(SUFFIX)
        | F.col("text").contains(MIDDLE)
        | (F.pmod(_group("digest", 2), F.lit(100)) >= FIM_RATE)
    )
    form = F.when(plain, "plain").when(F.pmod(_group("digest", 3), F.lit(100)) < SPM_RATE, "spm").otherwise("psm")
    return with_units.select(
        *_ID,
        "copies",
        "text",
        "n",
        form.alias("form"),
        chars(F.least(*cuts)).alias("a"),
        chars(F.greatest(*cuts)).alias("b"),
    )


def pieces(planned: DataFrame) -> DataFrame:
    """``key, h, len, copies, n, form, a, b, segment, start, piece, sentinel``:
    the output of each distinct row, in pieces; (segment, start) is the output
    order."""

    def segment(kind: str, start: Column | int = 0, stop: Column | int = 0) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(start).cast("long").alias("start"), F.lit(stop).cast("long").alias("stop"))

    a, b, n = F.col("a"), F.col("b"), F.col("len").cast("long")
    prefix, middle, suffix = segment("T", 0, a), segment("T", a, b), segment("T", b, n)
    segments = (
        F.when(F.col("form") == "plain", F.array(segment("T", 0, n)))
        .when(F.col("form") == "psm", F.array(segment(PREFIX), prefix, segment(SUFFIX), suffix, segment(MIDDLE), middle))
        .otherwise(F.array(segment(SUFFIX), suffix, segment(PREFIX), prefix, segment(MIDDLE), middle))
    )

    def cut(seg: Column, i: Column) -> Column:
        # An empty plain text is one empty piece, so that every row has a piece.
        starts = F.when(
            seg["stop"] > seg["start"], F.sequence(seg["start"], seg["stop"] - 1, F.lit(PIECE).cast("long"))
        ).when(F.col("form") == "plain", F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
        content = F.transform(
            starts,
            lambda s: F.struct(
                i.alias("segment"),
                s.alias("start"),
                F.substring(F.col("text"), (s + 1).cast("int"), F.least(F.lit(PIECE), seg["stop"] - s).cast("int")).alias("piece"),
                F.lit(False).alias("sentinel"),
            ),
        )
        marker = F.array(F.struct(i.alias("segment"), F.lit(0).cast("long").alias("start"), seg["kind"].alias("piece"), F.lit(True).alias("sentinel")))
        return F.when(seg["kind"] == "T", content).otherwise(marker)

    made = F.flatten(F.transform(segments, cut))
    return planned.select(*_ID, *_INFO, F.explode(made).alias("p")).select(*_ID, *_INFO, "p.*")


def _digests(sorted_pieces: DataFrame, key_ddl: str, name: str) -> DataFrame:
    """sha256 of the pieces of each row, in the order the partition holds them,
    with the row's own columns: ``key, h, len, copies, n, form, a, b, name``."""
    width = len(_ID) + len(_INFO)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        digests: list[str] = []
        current, state, schema = None, None, None

        def close() -> None:
            if state is not None:
                rows.append(current)
                digests.append(state.hexdigest())

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(width)]
            names = [*_ID, *_INFO, name]
            return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=names)

        for batch in batches:
            schema = batch.schema
            ids = zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)
            texts = batch.column(width).to_pylist()
            for row, piece in zip(ids, texts, strict=True):
                if row != current:
                    close()
                    current, state = row, hashlib.sha256()
                state.update(piece.encode("utf-8", "surrogatepass"))
            if len(digests) >= 1000:
                yield flush()
                rows, digests = [], []
        close()
        if digests:
            yield flush()

    info = "copies long, n long, form string, a long, b long"
    return sorted_pieces.mapInArrow(run, f"{key_ddl}, h long, len int, {info}, {name} string")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): ``rows`` has per distinct row ``key, h, len, copies, n,
    form, prefix_chars, middle_chars``; ``pieces`` its output in pieces."""
    planned = plan(docs, key, text, seed)
    rows = planned.select(
        *_ID,
        "copies",
        "n",
        "form",
        F.when(F.col("form") != "plain", F.col("a")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("b") - F.col("a")).alias("middle_chars"),
    )
    return rows, pieces(planned)


def _left(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` with the digest of their identity; null keys match."""
    other = digests.select(*[F.col(c).alias(f"_{c}") for c in digests.columns])
    same = [rows[c].eqNullSafe(other[f"_{c}"]) for c in _ID]
    joined = rows.join(other, same[0] & same[1] & same[2], "left")
    name = digests.columns[-1]
    return joined.select(*rows.columns, F.col(f"_{name}").alias(name))


def restored_order(out: DataFrame) -> DataFrame:
    """The content pieces of an output with their role, read from the output
    alone: the last sentinel before a piece names it; none means plain."""
    order = Window.partitionBy(*_ID).orderBy("segment", "start").rowsBetween(Window.unboundedPreceding, 0)
    role = F.last(F.when(F.col("sentinel"), F.col("piece")), ignorenulls=True).over(order)
    rank = F.when(role == MIDDLE, 1).when(role == SUFFIX, 2).otherwise(0)
    return out.select("*", rank.alias("role")).where(~F.col("sentinel"))


def fim_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256``: one row for each row of ``docs``."""
    out = pieces(plan(docs, key, text, seed))
    key_ddl = ddl(docs, key, "key")
    columns = [*_ID, *_INFO, "piece"]
    output = _digests(
        out.sortWithinPartitions(*_ID, "segment", "start").select(*columns), key_ddl, "output_sha256"
    )
    restored = _digests(
        restored_order(out).sortWithinPartitions(*_ID, "role", "segment", "start").select(*columns),
        key_ddl,
        "restored_sha256",
    )
    joined = _left(output, restored.select(*_ID, "restored_sha256"))
    plain = F.col("form") == "plain"
    copies = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return joined.select(
        F.col("key").alias(key),
        "n",
        "form",
        F.when(~plain, F.col("a")).alias("prefix_chars"),
        F.when(~plain, F.col("b") - F.col("a")).alias("middle_chars"),
        "output_sha256",
        "restored_sha256",
        copies.alias("_copy"),
    ).drop("_copy")
