"""Vector expressions on ARRAY<FLOAT> columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unequal or zero vectors."""
    size = norm(a) * norm(b)
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(fits, dot(a, b) / size).otherwise(0.0)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
