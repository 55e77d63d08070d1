"""Array-column vector arithmetic as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_dist(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v)


def diag_quad(delta: Column, diag: list[float]) -> Column:
    """deltaᵀ diag(m) delta for a fixed diagonal."""
    m = F.array(*[F.lit(float(v)) for v in diag])
    t = F.zip_with(F.zip_with(delta, delta, lambda x, y: x * y), m, lambda x, w: x * w)
    return F.aggregate(t, F.lit(0.0), lambda acc, v: acc + v)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)
