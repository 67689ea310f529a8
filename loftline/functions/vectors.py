"""Column functions over ARRAY<FLOAT|DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v / (|v| + 1e-8), as doubles."""
    n = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), lambda s: F.sqrt(s) + EPSILON)
    return F.element_at(F.transform(F.array(n), lambda m: F.transform(v, lambda x: x.cast("double") / m)), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def clamped_similarity(sim: Column) -> Column:
    """The approximate path reports 1 - distance, never below 0."""
    return F.greatest(F.lit(0.0), sim)


def similarity_to_l2(sim: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * sim))


def root_normalize(v: Column) -> Column:
    """Square roots of the L1-normalised values."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")), lambda s: s + F.lit(1e-7))
    return F.element_at(F.transform(F.array(total), lambda t: F.transform(v, lambda x: F.sqrt(x.cast("double") / t))), 1)
