"""Scores of forecasts and of training runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_error(actual: Column, forecast: Column) -> Column:
    return (actual - forecast) * (actual - forecast)


def mse_aligned(
    actual: DataFrame,
    forecast: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    y: str = "value",
    yhat: str = "yhat",
) -> DataFrame:
    """Mean squared error over the timestamps both sides have."""
    both = actual.select(*keys, ts, y).join(forecast.select(*keys, ts, yhat), [*keys, ts])
    error = squared_error(F.col(y), F.col(yhat))
    return both.groupBy(*keys).agg(F.avg(error).alias("mse"), F.count(error).alias("n"))


def mse_positional(
    actual: DataFrame,
    forecast: DataFrame,
    keys: Sequence[str],
    step: str = "step",
    y: str = "value",
    yhat: str = "yhat",
) -> DataFrame:
    """Mean squared error of the i-th value against the i-th."""
    return mse_aligned(actual, forecast, keys, step, y, yhat)


def metrics5(pairs: DataFrame, keys: Sequence[str], y: str = "value", yhat: str = "yhat") -> DataFrame:
    """MAE, MSE, RMSE, MAPE and MSPE; the last two over rows whose actual is not 0."""
    error = F.col(yhat) - F.col(y)
    share = F.try_divide(error, F.col(y))
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(share)).alias("mape"),
        F.avg(share * share).alias("mspe"),
        F.count(error).alias("n"),
        F.count(share).alias("n_relative"),
    )


def window_mse(pairs: DataFrame, window: Sequence[str], y: str = "value", yhat: str = "yhat") -> DataFrame:
    return pairs.groupBy(*window).agg(F.avg(squared_error(F.col(y), F.col(yhat))).alias("loss"))


def topk_window_mse(
    pairs: DataFrame, window: Sequence[str], k: int, y: str = "value", yhat: str = "yhat"
) -> DataFrame:
    """The ``k`` windows with the largest mean squared error."""
    losses = window_mse(pairs, window, y, yhat)
    return losses.orderBy(F.col("loss").desc(), *window).limit(k)


def mined_share(epoch: Column, batch_size: Column) -> Column:
    """How many of a batch's windows count, by epoch."""
    narrowing = F.floor(batch_size * (5 - epoch) / (6 - epoch))
    half = F.floor(batch_size * F.lit(0.5))
    return F.when(epoch < 2, batch_size).when(epoch < 4, narrowing).otherwise(half).cast("bigint")


def hard_windows_by_epoch(
    losses: DataFrame,
    epoch: str = "epoch",
    batch: str = "batch",
    loss: str = "loss",
    tie: Sequence[str] = ("window_id",),
) -> DataFrame:
    """The hardest windows of every batch, fewer in later epochs. A batch has a fixed size."""
    by_batch = Window.partitionBy(epoch, batch)
    rank = F.row_number().over(by_batch.orderBy(F.col(loss).desc(), *tie))
    rows = losses.withColumn("rank", rank).withColumn("batch_size", F.count("*").over(by_batch))
    return rows.filter(F.col("rank") <= mined_share(F.col(epoch), F.col("batch_size")))


def counted(label: Column, ignore_zero: bool) -> Column:
    return label != 0 if ignore_zero else label >= 0


def gaussian_nll(
    df: DataFrame,
    label: str = "label",
    mu: str = "mu",
    sigma: str = "sigma",
    ignore_zero: bool = True,
) -> DataFrame:
    """Negative log likelihood under a normal law, and the squared error, of counted labels."""
    error = F.col(label) - F.col(mu)
    variance = F.col(sigma) * F.col(sigma)
    nll = F.log(F.col(sigma)) + F.lit(0.5 * math.log(2 * math.pi)) + error * error / (2 * variance)
    rows = df.filter(counted(F.col(label), ignore_zero))
    return rows.withColumn("nll", nll).withColumn("se", error * error)


def topk_each(df: DataFrame, cols: Sequence[str], k: int, tie: Sequence[str]) -> DataFrame:
    """``measure, rank, value`` of the ``k`` largest values of each column, ranked on their own."""
    parts = []
    for c in cols:
        top = df.select(F.col(c).alias("value"), *tie).orderBy(F.col("value").desc(), *tie).limit(k)
        rank = F.row_number().over(Window.orderBy(F.col("value").desc(), *tie))
        parts.append(top.select(F.lit(c).alias("measure"), rank.alias("rank"), "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def masked_abs_error(
    df: DataFrame, label: str = "label", mu: str = "mu", ignore_zero: bool = True
) -> DataFrame:
    rows = df.filter(counted(F.col(label), ignore_zero))
    return rows.withColumn("ae", F.abs(F.col(label) - F.col(mu)))


def best_epoch(
    log: DataFrame, keys: Sequence[str], loss: str = "mse", epoch: str = "epoch"
) -> DataFrame:
    """The log row with the lowest loss; the earliest epoch of equals."""
    best = F.min_by(F.struct(*[c for c in log.columns if c not in keys]), F.struct(loss, epoch))
    return log.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def repeat_mean(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("runs"))


def pooled_loss(
    batches: DataFrame, keys: Sequence[str], total: str = "loss_sum", count: str = "n"
) -> DataFrame:
    """All loss over all elements, not the mean of batch means."""
    return batches.groupBy(*keys).agg((F.sum(total) / F.sum(count)).alias("loss"))


def complete_horizons(forecasts: DataFrame, window: Sequence[str], horizon: int, step: str = "step") -> DataFrame:
    """Keep the windows for which every step was predicted."""
    full = forecasts.groupBy(*window).agg(F.count(step).alias("_n")).filter(F.col("_n") == horizon)
    return forecasts.join(full, list(window), "left_semi")


def forecast_overlay(
    actual: DataFrame, forecast: DataFrame, keys: Sequence[str], ts: str = "ts"
) -> DataFrame:
    """Actual and forecast on one time axis."""
    return actual.join(forecast, [*keys, ts], "full_outer")
