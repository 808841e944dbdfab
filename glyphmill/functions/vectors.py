"""Vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def truncate_normalize(v: Column, dims: int | None = None) -> Column:
    """Keep the first ``dims`` entries, then scale to unit length; a zero vector stays zero."""
    kept = as_double(v) if dims is None else F.slice(as_double(v), 1, dims)
    return let(norm(kept), lambda length: F.when(length > 0, F.transform(kept, lambda x: x / length)).otherwise(kept))


def argmax(v: Column) -> Column:
    """Position (from 0) of the first largest entry."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def log_sum_exp(v: Column) -> Column:
    return let(F.array_max(v), lambda top: top + F.ln(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def softmax(v: Column) -> Column:
    return let(log_sum_exp(v), lambda lse: F.transform(v, lambda x: F.exp(x - lse)))
