"""Answering forecast requests from a store of models, fitting those that are missing.

A request names a series, a model family and a step ahead. The store is asked first; only the
pairs of series and family that it lacks are fitted, and what comes of them, failures too, is
stored. Forecasts come from the stored rows alone, one path per pair however many requests ask
for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.functions.times import HOUR
from tideloom.models import arima, linear
from tideloom.operators.ordering import CHUNK, attach
from tideloom.session import settle
from tideloom.sources import store

Fit = Callable[[DataFrame, Sequence[str]], DataFrame]
Forecast = Callable[[DataFrame, Sequence[str]], DataFrame]


@dataclass(frozen=True)
class Family:
    """How a kind of model is fitted and how it forecasts.

    ``fit(rows, keys)`` gives a row per series, with a ``status`` (``ok`` where it can forecast)
    and all that ``forecast`` needs. ``forecast(models, keys)`` gives ``keys, step, ts, yhat`` up to
    each row's ``_ahead`` steps, or fewer.
    """

    fit: Fit
    forecast: Forecast


def ar1_family(period: timedelta = HOUR, chunk: int = CHUNK) -> Family:
    """First-order autoregression with a constant, by least squares."""

    def fit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        models = arima.ar1_fit(rows, keys, chunk=chunk, ends="ts")
        usable = F.col("phi").isNotNull() & F.col("level").isNotNull()
        return models.withColumn("status", F.when(usable, "ok").otherwise("failed: too few rows"))

    return Family(fit, lambda models, keys: arima.ar1_stored(models, keys, "_ahead", period))


def arima_family(order: tuple[int, int, int], gate: bool = True, period: timedelta = HOUR, chunk: int | None = None) -> Family:
    """ARIMA, behind the stationarity test unless ``gate`` is off."""
    return Family(
        lambda rows, keys: arima.arima_fit(rows, keys, order, gate=gate, chunk=chunk).drop("model"),
        lambda models, keys: arima.forecast_stored(models, keys, "_ahead", period=period),
    )


def sarimax_family(
    orders: Sequence[tuple[int, int, int]],
    seasonal_orders: Sequence[tuple[int, int, int, int]],
    period: timedelta = HOUR,
    chunk: int | None = None,
) -> Family:
    """Of a grid of seasonal orders the one with the lowest AIC; a failed row where none can be fitted."""

    def fit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        models = arima.sarimax_grid_fit(rows, keys, orders, seasonal_orders, chunk=chunk).drop("model")
        rest = [c for c in models.columns if c not in keys]
        # Usable rows first, then the lowest AIC; equals are settled by order.
        rank = F.struct(F.col("status") != "ok", F.col("aic").isNull(), "aic", "order")
        best = F.min_by(F.struct(*rest), rank).alias("_best")
        return models.groupBy(*keys).agg(best).select(*keys, "_best.*")

    return Family(fit, lambda models, keys: arima.forecast_stored(models, keys, "_ahead", period=period))


def window_family(
    context: int, horizon: int, penalty: float = 1e-6, period: timedelta = HOUR, chunk: int | None = None
) -> Family:
    """The linear model of a context window to the next ``horizon`` steps, and no further."""

    def fit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        models = linear.window_linear_fit(rows, keys, context, horizon, penalty=penalty, chunk=chunk)
        paths = linear.last_contexts(rows, keys, context).withColumnsRenamed({"_last": "last", "past": "context"})
        models = models.join(paths, list(keys), "left")
        usable = F.col("coefs").isNotNull() & F.col("context").isNotNull()
        return models.withColumn("status", F.when(usable, "ok").otherwise("failed: too few rows"))

    def forecast(models: DataFrame, keys: Sequence[str]) -> DataFrame:
        fitted = models.select(*keys, "coefs", "intercepts", "status")
        windows = models.select(*keys, F.col("last").alias("_last"), F.col("context").alias("past"))
        steps = linear.forecast_contexts(windows, fitted, keys, period=period)
        return steps.join(models.select(*keys, "_ahead"), list(keys)).where("step <= _ahead").drop("_ahead")

    return Family(fit, forecast)


def fit_wanted(rows: DataFrame, wanted: DataFrame, families: Mapping[str, Family], path: str, keys: Sequence[str]) -> None:
    """Fit and store every pair of ``wanted (keys, model)`` that the store at ``path`` lacks.

    A family whose models are all there costs no fit; of the others only the series that lack
    one are read. A series that a fit has nothing to say about is stored as failed.
    """
    spark = rows.sparkSession
    missing = settle(store.fit_missing(wanted.select(*keys, "model").distinct(), store.stored_models(spark, path, keys), keys))
    for name in sorted(r["model"] for r in missing.select("model").distinct().collect()):
        asked = missing.where(F.col("model") == name).select(*keys)
        fitted = families[name].fit(attach(rows, asked, keys, "left_semi"), list(keys))
        fitted = asked.join(fitted, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("failed: no rows")))
        store.save_models(fitted.withColumn("model", F.lit(name)), path)


def answer_requests(
    requests: DataFrame,
    rows: DataFrame,
    families: Mapping[str, Family],
    path: str,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """One answer per row of ``requests (request_id, keys, model, horizon)``.

    Returns ``request_id, keys, model, horizon, status, error, ts, yhat``. ``status`` is ``result``
    or ``error``, and an error says what is wrong: ``unknown series`` (not in ``rows``, or NULL),
    ``no such model`` (not one of ``families``), ``horizon must be positive``, ``no model: ...`` with
    the status of a fit that failed, or ``no forecast at this horizon``. Requests may repeat.

    Known pairs are collected first, fits happen for those the store at ``path`` lacks, and every
    family forecasts as far as the furthest request for each of its series.
    """
    keys = list(keys)
    spark = rows.sparkSession
    pair = [*keys, "model"]
    known = rows.select(*keys).distinct().withColumn("_known", F.lit(True))
    asked = requests.select("request_id", *pair, "horizon").join(known, keys, "left")
    asked = asked.withColumn("_family", F.coalesce(F.col("model").isin(*families), F.lit(False)))
    # Written, as the routes below and the answers read it.
    asked = settle(asked.withColumn("_sound", F.coalesce(F.col("_known") & F.col("_family") & (F.col("horizon") > 0), F.lit(False))))
    wanted = settle(asked.where("_sound").groupBy(*pair).agg(F.max("horizon").cast("int").alias("_ahead")))
    fit_wanted(rows, wanted, families, path, keys)
    models = store.stored_models(spark, path, keys)
    paths, states = None, wanted.select(*pair).withColumn("_status", F.lit(None).cast("string"))
    if models is not None:
        models = settle(models.join(wanted, pair))
        states = models.select(*pair, F.col("status").alias("_status"))
        for name in sorted(r["model"] for r in models.select("model").distinct().collect()):
            usable = models.where((F.col("model") == name) & (F.col("status") == "ok")).drop("model")
            steps = families[name].forecast(usable.withColumn("model", F.lit(name)), keys)
            steps = steps.select(*keys, F.lit(name).alias("model"), F.col("step").cast("long").alias("_step"), "ts", "yhat")
            paths = steps if paths is None else paths.unionByName(steps)
    rows_out = asked.join(states, pair, "left")
    if paths is None:
        rows_out = rows_out.withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "yhat": F.lit(None).cast("double")})
    else:
        rows_out = rows_out.withColumn("_step", F.col("horizon").cast("long")).join(paths, [*pair, "_step"], "left")
    error = (
        F.when(F.col("_known").isNull(), "unknown series")
        .when(~F.col("_family"), "no such model")
        .when(~F.col("_sound"), "horizon must be positive")
        .when(F.col("_status") != "ok", F.concat(F.lit("no model: "), "_status"))
        .when(F.col("yhat").isNull(), "no forecast at this horizon")
    )
    failed = error.isNotNull()
    return rows_out.select(
        "request_id",
        *pair,
        "horizon",
        F.when(failed, "error").otherwise("result").alias("status"),
        error.alias("error"),
        F.when(~failed, F.col("ts")).alias("ts"),
        F.when(~failed, F.col("yhat")).alias("yhat"),
    )
