"""Token counts of whole texts by a two-tier lookup in the map tasks.

Texts are cut into words that the vocabulary never joins. The token counts of the
most frequent words are broadcast as one table of ``table_size`` entries at most;
any other word goes to a cache of the worker, and to the tokenizers library if it
is not there. The words of the texts are not shuffled: the frequent ones are found
from lists, one per task and of bounded length, of its own most frequent words.
The tables only save time; every count is the library's.

Null texts count as empty: 0 bytes, 0 tokens. Rows that repeat a key each get
their count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import ddl, text_of, trimmed
from topicloom.llm.tokens import LONGEST, Cut, IdCounter, keeps_spaces, load, portions
from topicloom.session import materialize

# Entries of the broadcast table; words are LONGEST characters at most, so the
# table stays below about 20 MB.
TABLE_SIZE = 65_536
# Words a task counts at a time; beyond that, those met least are forgotten.
COUNTED = 300_000


def frequent_words(docs: DataFrame, tokenizer: str, table_size: int, text: str) -> DataFrame:
    """``word, n``: at most ``table_size`` of the most frequent words of all texts,
    by the sum of the counts that tasks report for their own most frequent ones.
    The least count is found from a histogram of the counts."""
    listed = 2 * table_size

    @trimmed
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keeps_spaces(load(tokenizer))
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in portions(batch.column(0)):
                cut = Cut(part, keep)
                times = np.bincount(cut.index, minlength=len(cut.chunks)).tolist()
                counts.update(dict(zip(cut.chunks, times, strict=True)))
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = [(w, n) for w, n in counts.most_common(listed) if n > 1 and len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            names=["word", "n"],
        )

    counted = materialize(
        docs.select(text_of(text).alias("text"))
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "frequent-words",
    )
    # Steps of a sixteenth of a power of two: 1,024 rows at most.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counted.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()
    least, rows = 1 << 30, 0
    for s in steps:
        rows += s["rows"]
        if rows > table_size:
            break
        least = s["step"]
    return counted.where(step >= least)


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    key: str = "doc_id",
    text: str = "text",
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row."""
    spark = docs.sparkSession
    top = [r["word"] for r in frequent_words(docs, tokenizer, table_size, text).collect()]
    shared = spark.sparkContext.broadcast(
        dict(zip(top, IdCounter(tokenizer).of_chunks(top), strict=True))
    )

    @trimmed
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = IdCounter(tokenizer, shared.value)
        for batch in batches:
            n_tokens = counter.count_all(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.binary_length(batch.column(1)).cast(pa.int64()),
                    pa.array(n_tokens),
                    pa.array(n_tokens > limit),
                ],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"{ddl(docs, key)}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(key, text_of(text).alias("text")).mapInArrow(count, schema)
