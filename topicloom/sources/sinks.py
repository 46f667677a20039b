"""Result sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(
    df: DataFrame,
    fmt: str,
    mode: str = "errorifexists",
    options: Mapping[str, str] | None = None,
    path: str | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Write to any Spark sink, optionally one folder per partition value.

    The rebalance hint lets AQE gather small values into one file and cut a
    value that holds much of the table (one huge cluster) into several.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode(mode).options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path) if path is not None else writer.save()


def write_coordinates(
    coords: DataFrame, path: str, key: str = "doc_id", mode: str = "errorifexists"
) -> None:
    """Numeric layout coordinates as gzip-compressed text."""
    coords.select(key, "x", "y").write.mode(mode).option("compression", "gzip").csv(path)


def read_coordinates(
    spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint"
) -> DataFrame:
    return spark.read.schema(f"`{key}` {key_type}, x double, y double").csv(path)
