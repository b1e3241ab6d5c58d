"""Array-column vector algebra evaluated by the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, v: s + v * v))


def _with_constant(a: Column, value: Column, f) -> Column:
    """``f(element, value)`` over an array; the constant is an array so it is computed once per row
    (a lambda would evaluate it again for every element)."""
    return F.zip_with(a, F.array_repeat(value, F.size(a)), f)


def l2_normalise(a: Column) -> Column:
    """Unit vector; the norm is floored at 1e-12 so a zero vector stays zero."""
    return _with_constant(as_double(a), F.greatest(norm(a), F.lit(1e-12)), lambda v, n: v / n)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the unit vectors, norms floored at 1e-12."""
    floor = F.lit(1e-12)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def add_scaled(a: Column, b: Column, scale: float) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + F.lit(float(scale)) * y)


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """Zero mean, unit (biased) variance over the vector."""
    x = as_double(a)
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    centred = _with_constant(x, mean, lambda v, m: v - m)
    deviation = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, v: s + v * v) / n + F.lit(float(eps)))
    return _with_constant(centred, deviation, lambda v, d: v / d)


def soft_threshold(value: Column, threshold: Column) -> Column:
    return F.signum(value) * F.greatest(F.abs(value) - threshold, F.lit(0.0))


def sum_vectors(df: DataFrame, keys: list[str], vector: str, dim: int,
                weight: Column | None = None, name: str = "x", mean: bool = False,
                extra: list[Column] | None = None) -> DataFrame:
    """Per-dimension SUM (or AVG) in one hash aggregation.

    Each dimension is its own aggregate, so partial sums are combined on the map side and a hot key
    costs one row per task in the shuffle instead of one row per vector.
    """
    def term(i: int) -> Column:
        v = F.col(vector)[i].cast("double")
        return v if weight is None else v * weight

    aggregate = F.avg if mean else F.sum
    wide = df.groupBy(*keys).agg(*[aggregate(term(i)).alias(f"_d{i}") for i in range(dim)], *(extra or []))
    kept = [c for c in wide.columns if not c.startswith("_d")]
    return wide.select(*kept, F.array(*[F.col(f"_d{i}") for i in range(dim)]).alias(name))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dimension_of(df: DataFrame, vector: str) -> int:
    """Vector length, read from one row."""
    row = df.select(F.size(vector).alias("d")).where("d > 0").head(1)
    return int(row[0]["d"]) if row else 0
