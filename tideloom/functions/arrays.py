"""Expressions on window arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what stands in for the value to be predicted.
MASKED = -1.0


def patches(x: Column, length: int) -> Column:
    """Consecutive patches of ``length``; a remainder is dropped at the front."""
    count = F.floor(F.size(x) / F.lit(length)).cast("int")
    start = F.size(x) - count * length
    cut = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.slice(x, start + i * length + 1, F.lit(length))
    )
    return F.when(count > 0, cut).otherwise(F.expr("CAST(array() AS ARRAY<ARRAY<DOUBLE>>)"))


def with_predict_token(past: Column, token: Column | None = None) -> Column:
    """Append one step: zero, or the given step (used for the first future covariates)."""
    return F.concat(past, F.array(F.lit(0.0) if token is None else token))


def masked_subwindow(x: Column, start: Column, length: Column) -> Column:
    """``length`` values from ``start`` (0-based), the last one masked."""
    head = F.slice(x, (start + 1).cast("int"), (length - 1).cast("int"))
    return F.concat(head, F.array(F.lit(MASKED)))


def dot(weights: Column, x: Column) -> Column:
    return F.aggregate(
        F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda total, term: total + term
    )


def array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + v) / F.size(x)


def array_spread(x: Column, ddof: int = 0) -> Column:
    """Standard deviation of an array around its mean."""
    # The mean is bound by a lambda; standing inside the sum it would be worked out for every element.
    squares = F.transform(
        F.array(array_mean(x)),
        lambda mean: F.aggregate(x, F.lit(0.0), lambda total, v: total + (v - mean) * (v - mean)),
    )[0]
    return F.sqrt(squares / F.nullif(F.size(x) - F.lit(ddof), F.lit(0)))
