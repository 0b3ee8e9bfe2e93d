"""Stationarity test and seasonal decomposition."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.models.moments import SeriesMoments, lag_moments
from tideloom.models.solve import adf_p_value, adf_statistic
from tideloom.operators.ordering import CHUNK, attach, chunk_window, drop_halo, spread, with_halo
from tideloom.session import settle


def default_adf_lags(n: int) -> int:
    """``ceil(12 * (n / 100) ** 0.25)``, but leaving enough rows for the regression."""
    return max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def level_and_change(df: DataFrame, keys: Sequence[str], value: str, pos: str, chunk: int) -> DataFrame:
    """Level around the series mean and change from the row before (0 in the first row)."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    rows = attach(df.select(*keys, pos, value), means, keys)
    rows = with_halo(rows.withColumn("level", F.col(value) - F.col("_mean")), chunk, before=1, pos=pos, keys=keys)
    change = F.col("level") - F.lag("level").over(chunk_window(keys, pos))
    rows = drop_halo(rows.withColumn("change", change))
    return rows.select(*keys, pos, "level", F.coalesce("change", F.lit(0.0)).alias("change"))


def stationarity_test(
    df: DataFrame,
    keys: Sequence[str],
    max_lag: int | None = None,
    value: str = "value",
    pos: str = "pos",
    significance: float = 0.05,
    chunk: int | None = None,
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant for every series.

    Every series chooses within ``default_adf_lags`` of its own length, and within ``max_lag`` where
    that is given. Returns ``adf_stat, adf_lags, nobs, p_value,
    stationary``; all are NULL for a series with missing values.
    """
    if max_lag is None:
        longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        max_lag = default_adf_lags(longest)
    rows = level_and_change(df, keys, value, pos, chunk or CHUNK)
    table = lag_moments(rows, ["level", "change"], keys, max_lag + 1, pos, chunk)
    fields = [
        *[df.schema[k] for k in keys],
        T.StructField("adf_stat", T.DoubleType()),
        T.StructField("adf_lags", T.IntegerType()),
        T.StructField("nobs", T.LongType()),
        T.StructField("p_value", T.DoubleType()),
        T.StructField("stationary", T.BooleanType()),
    ]
    key_names = list(keys)

    def test(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                label = [getattr(row, k) for k in key_names]
                moments = SeriesMoments(row.n, row.sums, row.moments, row.head, row.tail)
                if not np.isfinite(moments.moments).all():
                    out.append([*label, None, None, None, None, None])
                    continue
                varies = moments.n >= 6 and moments.moments[0, 0] > 1e-12
                if not varies:
                    out.append([*label, None, None, None, None, False])
                    continue
                stat, lags, nobs = adf_statistic(moments, min(max_lag, default_adf_lags(moments.n)))
                p = adf_p_value(stat)
                out.append([*label, stat, lags, nobs, p, p < significance])
            yield pd.DataFrame(out, columns=[f.name for f in fields])

    return spread(table, keys).mapInPandas(test, T.StructType(fields))


def dickey_fuller(
    df: DataFrame, keys: Sequence[str], value: str = "value", pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """The test without lagged changes: aggregates only, no Python.

    ``z`` is the normal quantile of the p-value in the region where rejection is decided.
    """
    rows = with_halo(df.select(*keys, pos, value), chunk, before=1, pos=pos, keys=keys)
    rows = drop_halo(rows.withColumn("_before", F.lag(value).over(chunk_window(keys, pos))))
    change = F.col(value) - F.col("_before")
    sums = rows.groupBy(*keys).agg(
        F.count("_before").alias("nobs"),
        F.regr_slope(change, F.col("_before")).alias("slope"),
        F.regr_sxx(change, F.col("_before")).alias("_sxx"),
        F.regr_syy(change, F.col("_before")).alias("_syy"),
    )
    rss = F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")
    noise = F.sqrt(rss / (F.col("nobs") - 2) / F.col("_sxx"))
    return sums.select(*keys, "nobs", "slope", (F.col("slope") / noise).alias("df_stat"))


def seasonal_decompose(
    df: DataFrame,
    keys: Sequence[str],
    period: int = 24,
    value: str = "value",
    pos: str = "pos",
    chunk: int = CHUNK,
) -> DataFrame:
    """Additive ``trend``, ``seasonal`` and ``resid``.

    The trend is a centred moving average over one period (half weight at both ends of an
    even period), NULL where the frame is not full; the seasonal part is the phase mean of the
    detrended values less the mean of the phase means.
    """
    half = period // 2
    rows = with_halo(df, chunk, before=half, after=half, pos=pos, keys=keys)
    order = chunk_window(keys, pos)
    frame = order.rowsBetween(-half, half)
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - F.lit(0.5) * (F.lag(value, half).over(order) + F.lead(value, half).over(order))
    full = F.count(value).over(frame) == 2 * half + 1
    # The phase means and the output both need the trend.
    rows = settle(drop_halo(rows.withColumn("trend", F.when(full, total / F.lit(float(period))))))
    phases = (
        rows.groupBy(*keys, (F.col(pos) % period).alias("_phase"))
        .agg(F.avg(F.col(value) - F.col("trend")).alias("_effect"))
    )
    centre = phases.groupBy(*keys).agg(F.avg("_effect").alias("_centre"))
    phases = attach(phases, centre, keys).select(
        *keys, "_phase", (F.col("_effect") - F.col("_centre")).alias("seasonal")
    )
    rows = rows.withColumn("_phase", F.col(pos) % period).join(phases, [*keys, "_phase"], "left")
    resid = F.col(value) - F.col("trend") - F.col("seasonal")
    return rows.withColumn("resid", resid).drop("_phase")
