"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for unequal lengths or a zero norm."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(
        F.size(a) == F.size(b), F.coalesce(F.try_divide(_dot(a, b), norm), F.lit(0.0))
    ).otherwise(F.lit(0.0))
