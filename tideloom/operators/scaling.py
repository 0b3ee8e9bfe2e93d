"""Scalers: ``fit_*`` aggregates training rows to a parameter table, ``scale`` applies it.

A parameter table has one row per series with columns ``<channel>__center`` and
``<channel>__scale``, so every scaler shares one apply and one inverse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.operators.ordering import attach
from tideloom.operators.quantiles import by_channel, exact_quantiles


def present(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def or_one(scale: Column) -> Column:
    """A constant channel is left unscaled."""
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def _pairs(cols: Sequence[str], center, scale) -> list[Column]:
    pairs = [(center(c).alias(f"{c}__center"), scale(c).alias(f"{c}__scale")) for c in cols]
    return [column for pair in pairs for column in pair]


def fit_minmax(train: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return train.groupBy(*keys).agg(
        *_pairs(
            cols,
            lambda c: F.min(present(c)),
            lambda c: or_one(F.max(present(c)) - F.min(present(c))),
        )
    )


def fit_standard(train: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation."""
    return train.groupBy(*keys).agg(
        *_pairs(cols, lambda c: F.avg(present(c)), lambda c: or_one(F.stddev_pop(present(c))))
    )


def fit_robust(train: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact median and interquartile range."""
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    table = by_channel(exact_quantiles(train, cols, probs, keys), cols, list(probs), keys)
    return table.select(
        *keys,
        *_pairs(
            cols,
            lambda c: F.col(f"{c}__q2"),
            lambda c: or_one(F.col(f"{c}__q3") - F.col(f"{c}__q1")),
        ),
    )


def _apply(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str], formula) -> DataFrame:
    rows = attach(df, params, keys)
    changed = {c: formula(F.col(c), F.col(f"{c}__center"), F.col(f"{c}__scale")) for c in cols}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


def scale(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return _apply(df, params, cols, keys, lambda x, center, width: (x - center) / width)


def unscale(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return _apply(df, params, cols, keys, lambda x, center, width: x * width + center)


def amplitude_scale(
    df: DataFrame, amplitudes: DataFrame, keys: Sequence[str], value: str = "value", v: str = "v"
) -> DataFrame:
    """Divide a series by its amplitude where that is positive; ``v`` stays for the inverse."""
    rows = attach(df, amplitudes, keys)
    scaled = F.when(F.col(v) > 0, F.col(value) / F.col(v)).otherwise(F.col(value))
    return rows.withColumn(value, scaled)


def amplitude_unscale(df: DataFrame, cols: Sequence[str], v: str = "v") -> DataFrame:
    return df.withColumns({c: F.col(c) * F.col(v) for c in cols})
