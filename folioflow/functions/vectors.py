"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where either vector is zero. Norms known already can be given."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def normalized(v: Column) -> Column:
    """The vector at length 1; an error for a zero vector."""
    n = norm(v)
    return F.when(n == 0, F.raise_error(F.lit("zero vector"))).otherwise(F.transform(doubles(v), lambda x: x / n))
