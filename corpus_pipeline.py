"""The corpus pipeline: from documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which the
caller writes and reads again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``, whatever they are. Scratch tables that a stage
leaves are deleted when the next stage begins, so a stage's result must be stored
by then; :func:`run` does so.

Nulls, empty tables, repeated rows and extra columns are treated as the operators
say: documents without words are rejected by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm import decontaminate, jaccard, line_dedup, packing, quality
from topicloom.llm.queries import table, vocabulary
from topicloom.session import materialize, release, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Texts that Spark hands to a Python worker at a time.
TEXTS_PER_BATCH = "300"

# Scratch tables of the stage before.
_left: list[str] = []


def _stage(apply: Stage) -> Stage:
    @wraps(apply)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
        release(spark, _left)
        before = set(written(spark))
        out = apply(spark, docs, sf_dir)
        _left[:] = [p for p in written(spark) if p not in before]
        return out

    return staged


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; a document of which nothing is left, too."""
    return line_dedup.without_repeats(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return jaccard.one_of_each_group(docs)


@_stage
def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences. The executors still hold what earlier
    stages took, so workers remember fewer pieces of text."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), remembered=100_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", remove_benchmarks),
    ("packing", pack),
]

# Tokenizing and exact binomial bounds are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
