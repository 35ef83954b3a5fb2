"""Array functions: products, distances, histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def emd_1d(a: Column, b: Column) -> Column:
    """Sum of absolute differences of the running sums of two histograms."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum"))
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x - y), start, step, lambda s: s["sum"])


def interior_fraction(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: F.isnan(x))) / F.size(v)


def finite_std(v: Column) -> Column:
    """Population standard deviation of the entries that are numbers; 0 if there is none."""
    f = F.filter(as_double(v), lambda x: ~F.isnan(x))
    n = F.nullif(F.size(f), F.lit(0))
    mean = F.aggregate(f, F.lit(0.0), lambda s, x: s + x) / n
    return F.coalesce(F.sqrt(F.aggregate(F.transform(f, lambda x: F.pow(x - mean, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / n), F.lit(0.0))


def arc_length(v: Column, closed: bool = False) -> Column:
    """Sum of absolute steps; with the step from last to first if closed."""
    ring = F.concat(v, F.slice(v, 1, 1)) if closed else v
    steps = F.zip_with(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda x, y: F.abs(x - y))
    return F.aggregate(as_double(steps), F.lit(0.0), lambda s, x: s + x)


def crossings(v: Column) -> Column:
    """Integers crossed between neighbours; a step from or to NaN counts none."""
    n = F.greatest(F.size(v) - 1, F.lit(0))
    steps = F.zip_with(F.slice(v, 2, n), F.slice(v, 1, n), lambda x, y: F.when(F.isnan(x) | F.isnan(y), F.lit(0.0)).otherwise(F.abs(F.floor(x) - F.floor(y)).cast("double")))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
