"""Vector expressions over ``array<float>`` columns. They stay in the JVM; vectors never pass through Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is missing, empty or zero."""
    n = norm(a) * norm(b)
    usable = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(usable & (n > 0), dot(a, b) / n).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_similarity(a: Column, b: Column) -> Column:
    """One less the Euclidean distance (the history search's measure; it can be negative)."""
    return 1 - l2(a, b)


def script_score(a: Column, b: Column) -> Column:
    """Cosine plus one, as a never negative search score."""
    return cosine(a, b) + 1.0
