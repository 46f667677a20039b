"""TF-IDF weights.

Weights live in the sparse vectors of a fitted ``TfidfVectorizer``, which are made
row by row. The long form ``(doc_id, term, tf, weight)`` is unfolded from them
last, so no token and no weight is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smoothed_idf(df: Column | str, n_docs: int) -> Column:
    df = F.col(df) if isinstance(df, str) else df
    return F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + df)) + F.lit(1.0)


def idf_table(vocabulary: DataFrame, n_docs: int) -> DataFrame:
    return vocabulary.select("term", "df", smoothed_idf("df", n_docs).alias("idf"))


def terms_of(model: PipelineModel) -> list[str]:
    """The fitted vocabulary, in the order of the vectors' places."""
    return next(s.getOrDefault("vocabulary") for s in model.stages if s.hasParam("vocabulary"))


def term_weights(
    model: PipelineModel, docs: DataFrame, key: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """``(key, *keep, term, tf, weight)`` of documents with ``stems``: weights of
    length 1 per document. Terms outside the vocabulary drop, so unseen documents
    are scored the same way."""
    spark = docs.sparkSession
    # The vocabulary is capped.
    names = spark.createDataFrame(list(enumerate(terms_of(model))), "place int, term string")
    counts, weights = F.unwrap_udt("counts"), F.unwrap_udt(model.stages[-1].getOutputCol())
    entries = F.arrays_zip(
        counts["indices"].alias("place"), counts["values"].alias("tf"), weights["values"].alias("weight")
    )
    unfolded = model.transform(docs).select(key, *keep, F.explode_outer(entries).alias("e"))
    return (
        unfolded.select(key, *keep, "e.place", F.col("e.tf").cast("bigint").alias("tf"), "e.weight")
        .join(F.broadcast(names), "place")
        .select(key, *keep, "term", "tf", "weight")
    )
