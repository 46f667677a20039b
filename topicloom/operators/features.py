"""Embedding features: Word2Vec, mean and nearest vectors, indexing, one-hot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from topicloom.functions.vectors import cosine, doubles, literal_vector
from topicloom.session import materialize

# Tokens that one task trains on, in tables that have more of them than four tasks do.
TOKENS_PER_PARTITION = 4_000_000


def fit_word2vec(
    docs: DataFrame,
    tokens: str = "stems",
    output: str = "features",
    vector_size: int = 100,
    seed: int = 42,
    min_count: int = 5,
    partitions: int | None = None,
) -> Word2VecModel:
    """Word vectors whose mean is a document's vector.

    Training is split over ``partitions``, whose vectors are combined: the result
    depends on it, so it is a parameter and not taken from the cluster. By default it
    follows from the table: 4, or one per ``TOKENS_PER_PARTITION`` tokens if these are
    more, so that a task's training does not grow with the table. The words that occur
    ``min_count`` times must fit the driver and every task.
    """
    if partitions is None:
        size = F.coalesce(F.sum(F.greatest(F.size(tokens), F.lit(0))), F.lit(0))
        partitions = max(4, -(-docs.agg(size).first()[0] // TOKENS_PER_PARTITION))
    return Word2Vec(
        vectorSize=vector_size,
        seed=seed,
        minCount=min_count,
        numPartitions=partitions,
        inputCol=tokens,
        outputCol=output,
    ).fit(docs)


def group_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, from per-task sums: ``(group, mean)``."""
    return df.groupBy(group).agg(
        vector_to_array(Summarizer.mean(array_to_vector(doubles(vector)))).alias("mean")
    )


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group in long form ``(group, dim, mean)``."""
    means = group_means(df, group, vector)
    return means.select(group, F.posexplode_outer("mean").alias("dim", "mean"))


def nearest_vectors(
    df: DataFrame, key: str, vector: str, query: Sequence[float], k: int
) -> DataFrame:
    """The ``k`` rows most similar to one query vector by cosine."""
    scored = df.select(key, cosine(doubles(vector), literal_vector(query)).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def ordinals(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Number the rows of a totally ordered table 0, 1, 2, … without gathering
    them in one task: sort in ranges, count per range, add the range's offset."""
    ranged = df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ordinals").withColumn("_range", F.shiftright("_slot", 33))
    # One row per range of the sort, so the window below is over a short table.
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_offset")
    return (
        ranged.join(offsets, "_range")
        .withColumn(name, place.cast("bigint"))
        .drop("_slot", "_range", "_offset")
    )


def string_index(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, idx)``: values by falling frequency, ties by value."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return ordinals(counts, "idx", F.desc("n"), "value")


def one_hot(df: DataFrame, column: str, names: Mapping[object, str]) -> DataFrame:
    """Add one 0/1 integer column per category, named by ``names[category]``."""
    flags = [
        F.col(column).eqNullSafe(F.lit(value)).cast("int").alias(name)
        for value, name in names.items()
    ]
    return df.select("*", *flags)


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Concatenate numeric, array and vector columns into one vector."""
    for name in columns:
        if isinstance(df.schema[name].dataType, T.ArrayType):
            df = df.withColumn(name, array_to_vector(doubles(name)))
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)
