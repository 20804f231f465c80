"""Vectors and score maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays: 0 where a norm is 0; an error where the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(value)


def interpolate(s: Column, x: Column, y: Column) -> Column:
    """Linear between the knots, constant beyond them; of knots at one place the first counts. No knots: s itself."""
    n = F.size(x)
    k = F.size(F.filter(x, lambda v: v <= s))  # knots at or before s
    lo, hi = F.get(x, k - 1), F.get(x, k)
    inside = F.get(y, k - 1) + F.when(hi == lo, F.lit(0.0)).otherwise((F.get(y, k) - F.get(y, k - 1)) * (s - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return F.when(n == 0, s).when(k == 0, F.get(y, F.lit(0))).when(k >= n, F.get(y, n - 1)).otherwise(inside)


def calibrated(score: Column, method: Column, a: Column, b: Column, x: Column, y: Column) -> Column:
    """A raw score of 0 to 100 through a category's map (identity, sigmoid or isotonic), within 0 to 100."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 100.0))
    mapped = F.when(method == "sigmoid", F.lit(1.0) / (F.lit(1.0) + F.exp(a * s + b))).when(method == "isotonic", interpolate(s, x, y)).otherwise(s)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), mapped * 100.0))


def band(score: Column, medium: float = 60.0, high: float = 80.0) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
