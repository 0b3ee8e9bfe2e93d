"""ARIMA and SARIMAX over many series and candidate orders.

Estimation minimises the conditional sum of squares with zero pre-sample values. A fit starts
from the lag moments of ``tideloom.models.moments``: one pass over the data per differencing gives
every order a starting point, with the residual filter cut after ``lags`` terms. From there
``tideloom.models.scan`` goes on with the exact residuals of whole series until the sum of squares
is at its minimum, so neither the cut nor the chunks have a part in the result.

A model row holds all that a forecast needs: the last levels and the last residuals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.times import HOUR, shift
from tideloom.models.diagnostics import stationarity_test
from tideloom.models.moments import SeriesMoments, lag_moments
from tideloom.models.scan import Model, _Row, blocks_of, fit_whole, levels_of, refine
from tideloom.models.solve import ArmaShape, difference, fit_arma, integrate, ridge
from tideloom.operators.ordering import CHUNK, attach, chunk_window, drop_halo, keep_last, spread, with_halo
from tideloom.session import settle

#: Terms of the residual filter in the search for a starting point.
LAGS = 128
NO_SEASON = (0, 0, 0, 1)

MODEL_FIELDS = [
    T.StructField("model", T.StringType()),
    T.StructField("order", T.ArrayType(T.IntegerType())),
    T.StructField("params", T.ArrayType(T.DoubleType())),
    T.StructField("mean", T.DoubleType()),
    T.StructField("sigma2", T.DoubleType()),
    T.StructField("aic", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("residuals", T.ArrayType(T.DoubleType())),
    T.StructField("tail", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("last", T.TimestampNTZType()),
]
SOLVED_FIELDS = [
    *[f for f in MODEL_FIELDS if f.name in ("order", "params", "mean", "n")],
    T.StructField("squares", T.DoubleType()),
    T.StructField("common_squares", T.DoubleType()),
    T.StructField("residuals", T.ArrayType(T.DoubleType())),
    T.StructField("status", T.StringType()),
]
START_FIELDS = [*[f for f in MODEL_FIELDS if f.name in ("order", "params", "mean", "n", "status")], T.StructField("_id", T.IntegerType())]


def difference_weights(d: int, seasonal: int, season: int) -> dict[int, int]:
    """``(1-B)^d (1-B^s)^D`` as lag → weight."""
    unit = np.eye(1, d + seasonal * season + 1)[0]
    taps = unit
    for step, times in ((1, d), (season, seasonal)):
        for _ in range(times):
            taps = taps - np.concatenate([np.zeros(step), taps[:-step]])
    return {int(lag): int(w) for lag, w in enumerate(taps) if w}


def differenced(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    d: int,
    seasonal: int = 0,
    season: int = 1,
    pos: str = "pos",
    chunk: int = CHUNK,
) -> DataFrame:
    """Difference every column; rows without a full history are left out, ``pos`` starts at 0."""
    weights = difference_weights(d, seasonal, season)
    reach = max(weights)
    if reach == 0:
        return df.select(*keys, pos, *cols)
    rows = with_halo(df.select(*keys, pos, *cols), chunk, before=reach, pos=pos, keys=keys)
    order = chunk_window(keys, pos)

    def change(c: str) -> Column:
        terms = [F.lag(c, lag).over(order) * F.lit(w) if lag else F.col(c) * F.lit(w) for lag, w in weights.items()]
        return sum(terms[1:], terms[0])

    rows = rows.select(*keys, pos, "_chunk", "_home", *[change(c).alias(c) for c in cols])
    rows = drop_halo(rows).filter(F.col(pos) >= reach)
    return rows.withColumn(pos, F.col(pos) - reach)


def _start(moments: SeriesMoments, shape: ArmaShape) -> tuple[np.ndarray | None, str]:
    """A starting point and the status: ``ok``, or why there is none."""
    if not np.isfinite(moments.moments).all():
        return None, "failed: missing values"
    if moments.n < shape.size + 3:
        return None, "failed: too few rows"
    if moments.moments[0, 0] <= 1e-12:
        return None, "failed: constant series"
    params, _ = fit_arma(moments, shape)
    return params, "ok" if params is not None else "failed: no stable solution"


def filter_reach(order: tuple, seasonal: tuple, lags: int) -> int:
    """Terms of the residual filter in the search: all of them where no moving average makes it endless."""
    (p, _, q), (P, _, Q, s) = order, seasonal
    return max(lags, s * (1 + P) + p) if q or Q else max(p + P * s, 1)


def _starter(keys: Sequence[str], orders: Sequence[tuple], ids: Sequence[int], regressors: int, names: list[str]):
    key_names = list(keys)

    def fit_row(row):
        order, seasonal = orders[row.order_id]
        label = [getattr(row, k) for k in key_names]
        moments = SeriesMoments(row.n, row.sums, row.moments, row.head, row.tail)
        params, status = _start(moments, ArmaShape(order, seasonal, regressors))
        params = None if params is None else params.tolist()
        return [*label, [*order, *seasonal], params, row.mean, moments.n, status, ids[row.order_id]]

    def solve(batches):
        for batch in batches:
            yield pd.DataFrame([fit_row(r) for r in batch.itertuples(index=False)], columns=names)

    return solve


def _whole_fits(
    blocks: DataFrame, keys: Sequence[str], orders: Sequence[tuple[tuple, tuple]], regressors: int, constant: bool, lags: int, common: int
) -> DataFrame:
    """``SOLVED_FIELDS`` of all orders for series that one block holds: starting point and fit in one task."""
    schema = T.StructType([*[blocks.schema[k] for k in keys], *SOLVED_FIELDS])
    key_names = list(keys)

    def fit(levels: np.ndarray, order: tuple, seasonal: tuple) -> list:
        code, shape = (*order, *seasonal), ArmaShape(order, seasonal, regressors)
        _, d, _, _, D, _, s = code
        w = np.array([difference(x, d, D, s) for x in levels])
        mean = 0.0
        if constant and not d and not D and not regressors and w.size:
            mean = float(w[0].mean())
            w[0] -= mean
        params, status = _start(SeriesMoments.of(w, filter_reach(order, seasonal, lags)), shape)
        if params is None:
            return [list(code), None, mean, w.shape[1], None, None, None, status]
        model, sums, residuals, status = fit_whole(Model(code, params, mean, regressors), levels, common, True)
        if not len(sums):
            return [list(code), None, mean, w.shape[1], None, None, None, status]
        return [list(code), model.params.tolist(), mean, w.shape[1], sums[0], sums[1], residuals.tolist(), status]

    def run(batches):
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                row = _Row(dict(zip(batch.columns, values)))
                label, levels = [getattr(row, k) for k in key_names], levels_of(row)
                out += [[*label, *fit(levels, *o)] for o in orders]
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return spread(blocks, keys).mapInPandas(run, schema)


def _starts(
    df: DataFrame,
    keys: Sequence[str],
    orders: Sequence[tuple[tuple, tuple]],
    cols: Sequence[str],
    constant: bool,
    lags: int,
    pos: str,
    chunk: int | None,
) -> DataFrame:
    """``START_FIELDS`` per series and order, from lag moments; ``_id`` is the order's place in ``orders``."""
    schema = T.StructType([*[df.schema[k] for k in keys], *START_FIELDS])
    value, exog = cols[0], cols[1:]
    found = None
    by_difference: dict[tuple, list] = {}
    for at, (order, seasonal) in enumerate(orders):
        by_difference.setdefault((order[1], seasonal[1], seasonal[3]), []).append((at, (order, seasonal)))
    for (d, seasonal_d, season), group in by_difference.items():
        rows = differenced(df, cols, keys, d, seasonal_d, season, pos, chunk or CHUNK)
        rows = rows.select(*keys, pos, *[F.col(c).cast("double").alias(c) for c in cols])
        centred = constant and d == 0 and seasonal_d == 0 and not exog
        means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
        if centred:
            rows = attach(rows, means, keys).withColumn(value, F.col(value) - F.col("mean"))
        reach = max(filter_reach(o, s, lags) for _, (o, s) in group)
        table = lag_moments(rows, cols, keys, reach, pos, chunk)
        table = attach(table, means, keys) if centred else table.withColumn("mean", F.lit(0.0))
        table = table.withColumn("order_id", F.explode(F.lit(list(range(len(group))))))
        solve = _starter(keys, [o for _, o in group], [at for at, _ in group], len(exog), schema.fieldNames())
        part = spread(table, [*keys, "order_id"]).mapInPandas(solve, schema)
        found = part if found is None else found.unionByName(part)
    return settle(found)


def _ends(df: DataFrame, cols: Sequence[str], keys: Sequence[str], rows: int, pos: str, ts: str) -> DataFrame:
    """``keys, tail, last``: the last ``rows`` rows of every series as one array per channel, and the last time."""
    newest = keep_last(df, max(rows, 1), keys, pos)
    last = F.max(ts) if ts in df.columns else F.lit(None)
    packed = newest.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(pos, *cols))).alias("_rows"), last.cast("timestamp_ntz").alias("last")
    )
    tail = F.array(*[F.transform("_rows", lambda r: r[c].cast("double")) for c in cols])
    return packed.select(*keys, tail.alias("tail"), "last")


def _order_code(orders: Sequence[tuple[tuple, tuple]]) -> tuple[int, int]:
    """The largest halo, and the most rows lost to differencing, of the orders."""
    models = [Model((*o, *s), np.zeros(0)) for o, s in orders]
    return max(m.halo for m in models), max(m.reach for m in models)


def fit_orders(
    df: DataFrame,
    keys: Sequence[str],
    orders: Sequence[tuple[tuple, tuple]],
    model: str,
    value: str = "value",
    exog: Sequence[str] = (),
    constant: bool = False,
    lags: int = LAGS,
    pos: str = "pos",
    ts: str = "ts",
    chunk: int | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """A model row per series and order; a fit that fails says so in ``status``.

    ``sigma2`` is the mean square of all residuals. ``aic`` counts those behind the rows that any
    of ``orders`` loses to differencing, so orders of different differencing compare on one
    sample; it is NULL where that sample has no rows. A model that has not converged has status
    ``not converged``. ``residuals`` and ``tail`` are the last values that a forecast looks back
    on, ``last`` the time of the last row. ``lags`` bounds the search for a starting point
    and has no part in the result. ``only`` lists the series to solve.

    Series that one chunk holds are read once, their ends too, and fitted where it lies; only those
    of several chunks take the distributed passes of ``_long_fits``.
    """
    cols = [value, *exog]
    halo, common = _order_code(orders)
    packed = blocks_of(df, cols, keys, halo, pos, chunk or CHUNK, F.col(ts) if ts in df.columns else F.lit(None))
    if only is not None:
        packed = attach(packed, only, keys, "left_semi")
    blocks = packed.drop("_tail", "_time")
    ends = packed.groupBy(*keys).agg(F.max_by(F.struct(F.col("_tail").alias("tail"), F.col("_time").alias("last")), "_chunk").alias("_end"))
    sizes = blocks.groupBy(*keys).agg(F.max("_chunk").alias("_last"))
    whole = attach(blocks, sizes.where("_last = 0"), keys, "left_semi")
    solved = _whole_fits(whole, keys, orders, len(exog), constant, lags, common)
    long = settle(sizes.where("_last > 0").select(*keys))
    if not long.isEmpty():
        solved = solved.unionByName(_long_fits(df, blocks, long, keys, orders, cols, constant, lags, common, pos, chunk))
    # Fits are dear and their rows few: written, so that nothing below fits twice.
    rows = attach(settle(solved), ends.select(*keys, "_end.*"), keys)
    code = F.col("order")
    counted = F.col("n") + code[1] + code[4] * code[6] - F.lit(common)
    size = code[0] + code[2] + code[3] + code[5] + F.lit(len(exog))
    noise = F.greatest(F.col("common_squares") / counted, F.lit(1e-300))
    aic = F.when(counted > 0, counted * (F.log(F.lit(2 * math.pi) * noise) + 1) + 2 * (size + 1))
    return rows.select(
        *keys,
        F.lit(model).alias("model"),
        "order",
        "params",
        F.when(F.col("params").isNotNull(), F.col("mean")).alias("mean"),
        F.greatest(F.col("squares") / F.col("n"), F.lit(1e-300)).alias("sigma2"),
        aic.alias("aic"),
        "n",
        "status",
        "residuals",
        F.when(F.col("params").isNotNull(), F.col("tail")).alias("tail"),
        "last",
    )


def _long_fits(
    df: DataFrame,
    blocks: DataFrame,
    long: DataFrame,
    keys: Sequence[str],
    orders: Sequence[tuple[tuple, tuple]],
    cols: Sequence[str],
    constant: bool,
    lags: int,
    common: int,
    pos: str,
    chunk: int | None,
) -> DataFrame:
    """``SOLVED_FIELDS`` for series of several chunks: starting points from lag moments, then ``refine``."""
    starts = _starts(attach(df, long, keys, "left_semi"), keys, orders, cols, constant, lags, pos, chunk)
    ready = starts.filter("status = 'ok'").select(*keys, "_id", F.col("order").alias("code"), "params", "mean", F.lit(True).alias("free"))
    found = refine(attach(blocks, long, keys, "left_semi"), ready, keys, len(cols) - 1, common)
    found = found.withColumnsRenamed({"params": "_params", "status": "_status"})
    rows = starts.join(found, [*keys, "_id"], "left")
    return rows.select(
        *keys, "order", F.col("_params").alias("params"), "mean", "n", "squares", "common_squares", "residuals",
        F.coalesce("_status", "status").alias("status"),
    )


def arima_fit(
    df: DataFrame,
    keys: Sequence[str],
    order: tuple[int, int, int] = (1, 1, 1),
    value: str = "value",
    pos: str = "pos",
    adf_lags: int | None = None,
    gate: bool = True,
    lags: int = LAGS,
    ts: str = "ts",
    chunk: int | None = None,
) -> DataFrame:
    """ARIMA for every series that passes the stationarity test.

    A series that fails the test gets a row with status ``non-stationary`` and no parameters,
    and is not solved; one with missing values has status ``failed: missing values``. Undifferenced
    models have a constant. ``adf_lags`` bounds the lag search of the test; without it every
    series' own length does.
    """
    grid = [(tuple(order), NO_SEASON)]
    options = {"constant": True, "lags": lags, "pos": pos, "ts": ts, "chunk": chunk}
    if not gate:
        return fit_orders(df, keys, grid, "arima", value, **options)
    tested = settle(stationarity_test(df, keys, adf_lags, value, pos, chunk=chunk))
    passed = tested.filter("stationary").select(*keys)
    fitted = fit_orders(df, keys, grid, "arima", value, only=passed, **options)
    code = F.array(*[F.lit(v) for v in (*order, *NO_SEASON)])
    empty = {f.name: F.lit(None).cast(f.dataType) for f in MODEL_FIELDS}
    reason = F.when(F.col("stationary").isNull(), "failed: missing values").otherwise("non-stationary")
    empty |= {"model": F.lit("arima"), "order": code, "status": reason}
    refused = tested.filter("stationary IS NULL OR NOT stationary").select(*keys, *[c.alias(name) for name, c in empty.items()])
    return fitted.unionByName(refused)


def sarimax_grid_fit(
    df: DataFrame,
    keys: Sequence[str],
    orders: Sequence[tuple[int, int, int]] = ((1, 1, 1),),
    seasonal_orders: Sequence[tuple[int, int, int, int]] = ((1, 0, 0, 24),),
    value: str = "value",
    exog: Sequence[str] = (),
    pos: str = "pos",
    lags: int = LAGS,
    ts: str = "ts",
    chunk: int | None = None,
) -> DataFrame:
    """Every order with every seasonal order, with regressors, for every series."""
    grid = [(tuple(o), tuple(s)) for o in orders for s in seasonal_orders]
    return fit_orders(df, keys, grid, "sarimax", value, exog, lags=lags, pos=pos, ts=ts, chunk=chunk)


def end_states(
    df: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    exog: Sequence[str] = (),
    pos: str = "pos",
    ts: str = "ts",
    chunk: int = CHUNK,
) -> DataFrame:
    """The usable ``models``, their parameters as they stand, brought to the end of ``df``.

    For models fitted earlier, or on part of a series: ``residuals``, ``tail`` and ``last`` are
    those after the last row of ``df``. Models of series that ``df`` does not have are left out.
    """
    cols = [value, *exog]
    usable = models.filter("status = 'ok'").select(*keys, "model", "order", "params", "mean")
    numbered = Window.partitionBy(*keys).orderBy("model", "order")
    usable = settle(usable.withColumn("_id", F.row_number().over(numbered)))
    code = F.col("order")
    halo = usable.agg(F.max(code[0] + code[1] + (code[3] + code[4]) * code[6])).first()[0] or 0
    asked = usable.select(*keys, "_id", code.alias("code"), "params", "mean", F.lit(False).alias("free"))
    blocks = blocks_of(df, cols, keys, halo, pos, chunk)
    found = refine(blocks, asked, keys, len(exog), 0).select(*keys, "_id", "residuals")
    rows = attach(usable.join(found, [*keys, "_id"]), _ends(df, cols, keys, halo, pos, ts), keys)
    return rows.drop("_id").withColumn("status", F.lit("ok"))


def _path(model: Model, tail: np.ndarray, residuals: np.ndarray, coming: np.ndarray) -> np.ndarray:
    """Levels after the end of a series: no noise to come, regressors ``coming`` (a row per regressor)."""
    _, d, _, _, D, _, s = model.code
    k, horizon = model.regressors, coming.shape[1]
    ar, ma, *_ = model.factors()
    levels = tail[0] - model.params[:k] @ tail[1:]
    known = difference(levels, d, D, s) - model.mean
    w = np.concatenate([np.zeros(len(ar)), known, np.zeros(horizon)])
    e = np.concatenate([residuals, np.zeros(horizon)])
    first, r = len(ar) + len(known), len(residuals)
    for h in range(horizon):
        w[first + h] = ma[1:] @ e[h : h + r][::-1] - ar[1:] @ w[first + h - len(ar) + 1 : first + h][::-1]
    return integrate(levels, w[first:] + model.mean, d, D, s) + model.params[:k] @ coming


def forecast_stored(
    models: DataFrame,
    keys: Sequence[str],
    horizon: int | str,
    exog: Sequence[str] = (),
    future: DataFrame | None = None,
    period: timedelta = HOUR,
    ts: str = "ts",
) -> DataFrame:
    """``keys, model, order, step, ts, yhat`` from model rows alone, without their series.

    ``horizon`` may name a column of ``models``. Models with regressors need ``future (keys, step,
    exog…)``; from the first step on that a series' rows do not cover, ``yhat`` is NULL.
    """
    count = len(exog)
    rows = models.filter("status = 'ok'")
    rows = rows.withColumn("_horizon", F.col(horizon).cast("int") if isinstance(horizon, str) else F.lit(horizon))
    if count:
        if future is None:
            raise ValueError("models with regressors need a table of their future values")
        packed = future.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", *exog))).alias("_future"))
        # Steps count from 1 without a hole; what follows a hole is not known.
        packed = packed.withColumn("_future", F.filter("_future", lambda r, i: r["step"] == i + 1))
        ahead = F.array(*[F.transform("_future", lambda r: r[c].cast("double")) for c in exog])
        rows = rows.join(packed.select(*keys, ahead.alias("_ahead")), list(keys), "left")
    else:
        rows = rows.withColumn("_ahead", F.array().cast("array<array<double>>"))

    def extend(
        tail: pd.Series, residuals: pd.Series, ahead: pd.Series, code: pd.Series, params: pd.Series, mean: pd.Series, steps: pd.Series
    ) -> pd.Series:
        out = []
        for channels, errors, coming, order, theta, level, n in zip(tail, residuals, ahead, code, params, mean, steps):
            x = np.full((count, n), np.nan)
            for row, values in zip(x, coming if coming is not None else []):
                known = np.asarray(values, dtype=float)[:n]
                row[: len(known)] = known
            model = Model.of(order, theta, level, count)
            levels = np.array([np.asarray(c, dtype=float) for c in channels])
            out.append(_path(model, levels, np.asarray(errors, dtype=float), x).tolist())
        return pd.Series(out)

    extended = F.pandas_udf(extend, T.ArrayType(T.DoubleType()))
    rows = spread(rows, keys).withColumn("_path", extended("tail", "residuals", "_ahead", "order", "params", "mean", "_horizon"))
    steps = rows.select(*keys, "model", "order", "last", F.posexplode("_path").alias("_at", "yhat"))
    return steps.select(
        *keys,
        "model",
        "order",
        (F.col("_at") + 1).alias("step"),
        shift(F.col("last"), F.col("_at") + 1, period).alias(ts),
        F.nanvl("yhat", F.lit(None)).alias("yhat"),
    )


def repeated_regressors(df: DataFrame, keys: Sequence[str], horizon: int, exog: Sequence[str], pos: str = "pos") -> DataFrame:
    """``keys, step, exog…``: the last ``horizon`` rows of every series, as if they came again."""
    ends = df.groupBy(*keys).agg(F.greatest(F.max(pos) - horizon, F.lit(-1)).alias("_before"))
    newest = attach(df, ends, keys).filter(F.col(pos) > F.col("_before"))
    return newest.select(*keys, (F.col(pos) - F.col("_before")).cast("int").alias("step"), *exog)


def forecast_models(
    df: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    horizon: int,
    value: str = "value",
    exog: Sequence[str] = (),
    future: DataFrame | None = None,
    period: timedelta = HOUR,
    pos: str = "pos",
    ts: str = "ts",
    lags: int = LAGS,
) -> DataFrame:
    """``keys, model, order, step, ts, yhat`` after the last row of ``df`` for every usable model row.

    The models are brought to the end of ``df`` first (``end_states``); rows as ``fit_orders``
    returns them, at the end of their series already, go to ``forecast_stored`` directly. Without a
    ``future`` table the regressors of the last ``horizon`` rows stand in for the coming ones.
    ``lags`` has no effect and is kept for callers that pass it.
    """
    if exog and future is None:
        future = repeated_regressors(df, keys, horizon, exog, pos)
    states = end_states(df, models, keys, value, exog, pos, ts)
    return forecast_stored(states, keys, horizon, exog, future, period, ts)


def arima_forecast(df: DataFrame, models: DataFrame, keys: Sequence[str], horizon: int, **options) -> DataFrame:
    return forecast_models(df, models, keys, horizon, **options)


def sarimax_forecast(
    df: DataFrame, models: DataFrame, keys: Sequence[str], horizon: int, exog: Sequence[str] = (), **options
) -> DataFrame:
    return forecast_models(df, models, keys, horizon, exog=exog, **options)


def ar1_fit(
    df: DataFrame, keys: Sequence[str], value: str = "value", pos: str = "pos", chunk: int = CHUNK, ends: str | None = None
) -> DataFrame:
    """Least squares of a value on the one before it: ``phi``, ``intercept``, ``n_pairs``.

    With ``ends``, the name of the time, also the columns of ``ar1_ends``, from the same pass.
    """
    times = [] if ends is None else [ends]
    rows = with_halo(df.select(*keys, pos, value, *times), chunk, before=1, pos=pos, keys=keys)
    rows = drop_halo(rows.withColumn("_before", F.lag(value).over(chunk_window(keys, pos))))
    return rows.groupBy(*keys).agg(
        F.regr_slope(value, "_before").alias("phi"),
        F.regr_intercept(value, "_before").alias("intercept"),
        F.regr_count(value, "_before").alias("n_pairs"),
        *[c for name in times for c in (F.max_by(value, pos).alias("level"), F.max(name).alias("last"))],
    )


def ar1_forecast(
    df: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    horizon: int | str,
    period: timedelta = HOUR,
    value: str = "value",
    pos: str = "pos",
    ts: str = "ts",
) -> DataFrame:
    """Closed form ``m + phi^h (y - m)`` around the mean ``m = c / (1 - phi)``.

    ``horizon`` may name a column of ``models`` that gives each series its own.
    """
    return ar1_stored(ar1_ends(df, models, keys, value, pos, ts), keys, horizon, period, ts)


def ar1_ends(
    df: DataFrame, models: DataFrame, keys: Sequence[str], value: str = "value", pos: str = "pos", ts: str = "ts"
) -> DataFrame:
    """``models`` with ``level`` and ``last``, the last value and time of their series in ``df``."""
    ends = df.groupBy(*keys).agg(F.max_by(value, pos).alias("level"), F.max(ts).alias("last"))
    return attach(models, ends, keys)


def ar1_stored(models: DataFrame, keys: Sequence[str], horizon: int | str, period: timedelta = HOUR, ts: str = "ts") -> DataFrame:
    """``keys, step, ts, yhat`` from rows of ``ar1_ends`` alone."""
    steps = F.col(horizon).cast("int") if isinstance(horizon, str) else F.lit(horizon)
    rows = spread(models, keys).withColumn("step", F.explode(F.sequence(F.lit(1), steps)))
    mean = F.col("intercept") / (1 - F.col("phi"))
    path = F.when(
        F.col("phi") == 1, F.col("level") + F.col("step") * F.col("intercept")
    ).otherwise(mean + F.pow("phi", "step") * (F.col("level") - mean))
    return rows.select(*keys, "step", shift(F.col("last"), F.col("step"), period).alias(ts), path.alias("yhat"))


def ar_fit(
    df: DataFrame,
    keys: Sequence[str],
    order: int,
    value: str = "value",
    pos: str = "pos",
    chunk: int | None = None,
) -> DataFrame:
    """AR(p) with a constant by least squares: ``coefs`` (lag 1 first), ``intercept``, ``sigma2``."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("level"))
    rows = attach(df.select(*keys, pos, value), means, keys)
    rows = rows.withColumn(value, F.col(value) - F.col("level")).drop("level")
    table = attach(lag_moments(rows, [value], keys, order, pos, chunk), means, keys)
    fields = [
        *[df.schema[k] for k in keys],
        T.StructField("coefs", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("sigma2", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
    key_names = list(keys)

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                moments = SeriesMoments(row.n, row.sums, row.moments, row.head, row.tail)
                label = [getattr(row, k) for k in key_names]
                nobs = moments.n - order
                if nobs <= order + 1:
                    out.append([*label, None, None, None, moments.n])
                    continue
                terms = [(0, range(order + 1))]
                sums = moments.lag_sums(terms, order, moments.n - 1)
                gram = moments.gram(terms, order, moments.n - 1) - np.outer(sums, sums) / nobs
                coefs = ridge(gram[1:, 1:], gram[1:, 0])
                # Back from deviations around the series mean.
                constant = (sums[0] - coefs @ sums[1:]) / nobs + row.level * (1 - coefs.sum())
                rss = gram[0, 0] - coefs @ gram[1:, 0]
                out.append([*label, coefs.tolist(), float(constant), float(rss / nobs), moments.n])
            yield pd.DataFrame(out, columns=[f.name for f in fields])

    return spread(table, keys).mapInPandas(solve, T.StructType(fields))
