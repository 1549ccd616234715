"""Vector expressions on array columns, evaluated in the JVM. Arithmetic is in doubles, in array order.

For many pairs of vectors use operators.knn, whose kernels work on whole batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def l2_squared(a: Column, b: Column) -> Column:
    """sum of squared differences."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    """F1, F11."""
    return F.sqrt(l2_squared(a, b))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_from_l2_squared(d: Column) -> Column:
    """valid for unit vectors."""
    return d / 2


def residual(v: Column, centroid: Column) -> Column:
    """P12."""
    return F.zip_with(doubles(v), doubles(centroid), lambda x, y: x - y)


def subvectors(v: Column, d: int, m: int) -> Column:
    """M slices of d / m components."""
    if d % m:
        raise ValueError(f"{d} dimensions do not divide into {m} subspaces")
    return F.array(*[F.slice(v, j * (d // m) + 1, d // m) for j in range(m)])


def nan_to_num(x: Column, biggest: float = 3.4028234663852886e38) -> Column:
    """NaN and null become 0, infinities the largest float."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).when(x > biggest, biggest).when(x < -biggest, -biggest).otherwise(x)


def compression_ratio(d: Column | int, m: Column | int) -> Column:
    """bits of a float vector over bits of its codes."""
    return (F.lit(d) if isinstance(d, int) else d) * 32 / ((F.lit(m) if isinstance(m, int) else m) * 8)


def ratio(a: Column, b: Column) -> Column:
    """NaN where the divisor is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float("nan")))
