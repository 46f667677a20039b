"""Arithmetic on array columns, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("array<double>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def norm(vector: Column) -> Column:
    return F.sqrt(total(F.transform(vector, lambda a: a * a)))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 when either vector is all zero."""
    size = norm(left) * norm(right)
    return F.when(size > 0, dot(left, right) / size).otherwise(F.lit(0.0))


def squared_distance(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)))


def tidy(value: Column, digits: int = 6) -> Column:
    """Round and turn negative zero into zero, for stable comparison."""
    return F.round(value, digits) + F.lit(0.0)
