"""Numbers with missing values, and arrays as vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) != float("inf")), F.lit(False))


def safe_numeric(c: Column, default: float = 0.0) -> Column:
    """As a double; ``default`` if it is missing, NaN or no number."""
    return F.coalesce(nan_to_null(c.try_cast("double")), F.lit(default))


def available(c: Column) -> Column:
    return nan_to_null(c.try_cast("double")).isNotNull()


def missing_or_empty(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column, eps: float = EPS) -> Column:
    """The unit vector as doubles; a norm below ``eps`` counts as ``eps``."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def entropy(p: Column) -> Column:
    """Of an array of probabilities, in nats; zeros add nothing."""
    return F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x * F.log(x))


def effective_dimension(p: Column) -> Column:
    """1 / sum of squares; 0 if all are 0."""
    return F.coalesce(F.try_divide(F.lit(1.0), F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))


def has_nonfinite(v: Column) -> Column:
    return F.coalesce(F.exists(v, lambda x: ~is_finite(x)), F.lit(False))
