"""Vector and score functions as native columns; scores are 32-bit floats summed in double where precision matters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def similarity(a: Column, b: Column) -> Column:
    return dot(a, b).cast("float")


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of doubles, away from zero at a half: only what lies near one goes by way of decimals, which costs a microsecond."""
    shifted = x * F.lit(10.0**digits)
    nearest = F.rint(shifted)
    clear = (F.abs(shifted - nearest) < 0.499999) & (F.abs(shifted) < 1e9)
    return F.when(clear, nearest / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(x, digits))


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def sum_vectors(vectors: Column, dim: int) -> Column:
    """Sum of an array of vectors; zeros where it is empty."""
    zero = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda _: F.lit(0.0))
    return F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))


def _ratio(d: Column) -> Column:
    return d / (F.lit(2.0) - d)


#: Distances by name, from the products a·a, b·b and a·b; the ``_normalized`` ones take unit vectors for granted.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": lambda a, b: F.sqrt(F.greatest(F.lit(0.0), dot(a, a) + dot(b, b) - 2 * dot(a, b))),
    "euclidean_normalized": lambda a, b: F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(a, b))),
    "cosine": lambda a, b: 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)),
    "cosine_normalized": lambda a, b: 1 - dot(a, b),
    "tanimoto": lambda a, b: 1 - dot(a, b) / (dot(a, a) + dot(b, b) - dot(a, b)),
    "tanimoto_normalized": lambda a, b: 1 - _ratio(dot(a, b)),
}


def boosted(score: Column, base_language: Column, language: Column, boosts: dict[str, float]) -> Column:
    """The score, times the boost of the *base* language where the other one differs from it."""
    factor = F.lit(1.0).cast("float")
    for code in sorted(boosts):
        factor = F.when(base_language == code, F.lit(boosts[code]).cast("float")).otherwise(factor)
    return F.when(language != base_language, score * factor).otherwise(score).cast("float")


def _floats(columns: list[Column]) -> Column:
    return F.array(*[F.coalesce(c.cast("float"), F.lit(0.0).cast("float")) for c in columns])


def _folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))


#: Aggregations over the columns of a row, in single precision; nulls count as zero.
ROW_AGGREGATES: dict[str, Callable[[list[Column]], Column]] = {
    "max": lambda cs: F.array_max(_floats(cs)),
    "min": lambda cs: F.array_min(_floats(cs)),
    "sum": lambda cs: _folded(_floats(cs)),
    "mean": lambda cs: (_folded(_floats(cs)) / F.lit(float(len(cs))).cast("float")).cast("float"),
}


def linear_weighted(columns: list[Column], divisor: Column, weights: Column) -> Column:
    """Sum of value times weight over the shorter of the two, by the divisor."""
    values = _floats(columns)
    n = F.least(F.size(values), F.size(weights))
    products = F.zip_with(F.slice(values, 1, n), F.slice(weights, 1, n), lambda x, w: (x * w).cast("float"))
    return (_folded(products) / divisor.cast("float")).cast("float")
