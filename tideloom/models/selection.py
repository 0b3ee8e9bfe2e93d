"""Choosing models and answering forecast requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_by_aic(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The usable model with the lowest AIC per series; equals are settled by order.

    Rows with a ``status`` other than ``ok`` are not usable.
    """
    rest = [c for c in models.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("aic", "order"))
    usable = models.filter(F.col("aic").isNotNull())
    if "status" in rest:
        usable = usable.filter("status = 'ok'")
    return usable.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def model_select(scores: DataFrame, keys: Sequence[str], score: str = "rmse") -> DataFrame:
    """The model with the lowest hold-out score per series."""
    best = F.min_by(F.struct("model", score), F.struct(score, "model"))
    usable = scores.filter(F.col(score).isNotNull())
    return usable.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def forecast_requests(
    requests: DataFrame, series: DataFrame, models: DataFrame, forecasts: DataFrame, key: str = "series_id"
) -> DataFrame:
    """Answer a table of requests ``request_id, <key>, model, horizon``.

    ``status`` is ``result`` or ``error``; an error names what was missing. A result carries
    the forecast at the requested step. ``series`` lists known series, ``models`` the usable
    ``<key>, model`` pairs and ``forecasts`` their ``step, ts, yhat``.
    """
    known = series.select(key).distinct().withColumn("_series", F.lit(True))
    fitted = models.select(key, "model").distinct().withColumn("_model", F.lit(True))
    steps = forecasts.select(key, "model", F.col("step").alias("horizon"), "ts", "yhat")
    rows = (
        requests.join(known, [key], "left")
        .join(fitted, [key, "model"], "left")
        .join(steps, [key, "model", "horizon"], "left")
    )
    error = (
        F.when(F.col("_series").isNull(), "unknown series")
        .when(F.col("_model").isNull(), "no such model")
        .when(F.col("yhat").isNull(), "no forecast at this horizon")
    )
    return rows.select(
        "request_id",
        key,
        "model",
        "horizon",
        F.when(error.isNull(), "result").otherwise("error").alias("status"),
        error.alias("error"),
        "ts",
        "yhat",
    )
