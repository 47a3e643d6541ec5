"""Vector functions over ARRAY<DOUBLE>, as higher-order built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column, eps: float = EPS) -> Column:
    """Scaled to length 1; the zero vector stays."""
    scaled = lambda n: F.transform(a, lambda x: x / F.greatest(n, F.lit(eps)))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))  # the length is worked out once, not for each component


def cosine(a: Column, b: Column) -> Column:
    """0 where either is the zero vector."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def sign_bits(a: Column) -> Column:
    """Up to 64 components as bits of a long: bit i says that component i is positive."""
    return F.aggregate(F.transform(a, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def matvec(matrix: list[list[float]], a: Column) -> Column:
    """A small matrix times a vector; rows become literals."""
    return F.array(*[dot(F.array(*[F.lit(float(x)) for x in row]), a) for row in matrix])
