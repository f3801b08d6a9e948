"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a side is missing, lengths differ, or a norm is zero."""
    denom = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok & (denom != 0), dot(a, b) / denom).otherwise(F.lit(0.0))


def vector_literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
