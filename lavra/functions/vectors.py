"""Vectors as arrays, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2_normalize(vector: Column) -> Column:
    """The unit vector; a zero vector stays."""
    v = vector.cast("array<double>")
    norm = F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def l2_score(a: Column, b: Column) -> Column:
    """1 less the squared distance: 1 for equal vectors, below -1 for far ones. Null if the sizes differ."""
    return 1 - _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)))
