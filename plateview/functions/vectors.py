"""Dense-vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def norm(vector: Column) -> Column:
    return F.sqrt(total(F.transform(vector, lambda x: x * x)))


def softmax(scores: Column) -> Column:
    """Probabilities; shifted by the maximum so that no exponential overflows."""
    shifted = F.transform(scores, lambda z: F.exp(z - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / total(shifted))


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest entry; the first one if several tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
