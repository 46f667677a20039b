"""Table, query and view sources. Connection options always come from the caller."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def scan_table(
    spark: SparkSession,
    fmt: str,
    options: Mapping[str, str] | None = None,
    table: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Read a whole table through any Spark data source.

    Warehouse connectors take ``table`` (their ``dbtable`` option), file
    formats take ``path``. Column pruning and filters of later steps are pushed
    into the scan by the optimizer.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    if table is not None:
        reader = reader.option("dbtable", table)
    return reader.load(path) if path is not None else reader.load()


def scan_query(
    spark: SparkSession,
    query: str,
    fmt: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read the result of a query: in the source when ``fmt`` names a connector,
    otherwise over the session's own tables and views."""
    if fmt is None:
        return spark.sql(query)
    return spark.read.format(fmt).options(**(options or {})).option("query", query).load()


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def select_view(spark: SparkSession, name: str, columns: Sequence[str]) -> DataFrame:
    return spark.table(name).select(*columns)


def dimension(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small lookup table from local rows, e.g. cluster names and colours."""
    return spark.createDataFrame(list(rows), schema)
