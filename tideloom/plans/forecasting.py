"""Queries for tests, decomposition, fitting, forecasting and model choice."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideloom.functions.times import DAY
from tideloom.models import arima, backtest, diagnostics, linear, selection, serving
from tideloom.operators.evaluation import complete_horizons
from tideloom.operators.ordering import attach, with_length
from tideloom.operators.rolling import lag1
from tideloom.operators.splits import fraction
from tideloom.operators.windows import cut_windows, future_index
from tideloom.plans.base import (
    CHUNK,
    DAILY,
    HOURLY,
    HOURLY_GAPS,
    KEY,
    USER_HOURLY,
    daily,
    events,
    hourly,
    rounded,
    steady,
    steady_sql,
    user_hourly,
    wide,
)
from tideloom.plans.preparation import AR1_SQL
from tideloom.plans.registry import register
from tideloom.session import fresh_path, settle

# ---- 71-75 stationarity, decomposition, autoregression --------------------------------------


@register(
    "dickey_fuller",
    f"""WITH {USER_HOURLY},
pairs AS (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS before FROM user_hourly),
sums AS (SELECT series_id, count(before) AS nobs, regr_slope(value - before, before) AS slope,
  regr_sxx(value - before, before) AS sxx, regr_syy(value - before, before) AS syy FROM pairs GROUP BY 1)
SELECT series_id, nobs, round(slope, 6) AS slope, round(slope / sqrt((syy - slope * slope * sxx) / (nobs - 2) / sxx), 6) AS df_stat FROM sums""",
)
def dickey_fuller(spark, sf_dir):
    rows = diagnostics.dickey_fuller(user_hourly(spark, sf_dir), KEY, chunk=CHUNK)
    return rows.select(*KEY, "nobs", rounded("slope").alias("slope"), rounded("df_stat").alias("df_stat"))


@register("stationarity_test")
def stationarity_test(spark, sf_dir):
    rows = diagnostics.stationarity_test(settle(user_hourly(spark, sf_dir)), KEY, max_lag=20)
    return rows.select(
        *KEY, rounded("adf_stat").alias("adf_stat"), "adf_lags", "nobs", rounded("p_value").alias("p_value"), "stationary"
    )


@register(
    "stationarity_one_lag",
    f"""WITH {USER_HOURLY},
centred AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS level FROM user_hourly),
changes AS (SELECT *, lag(level) OVER o AS a, level - lag(level) OVER o AS y FROM centred WINDOW o AS (PARTITION BY series_id ORDER BY pos)),
terms AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM changes),
sums AS (
  SELECT series_id, count(b) AS m, count(a) AS n, regr_sxx(y, a) AS aa, regr_syy(y, a) AS yy, covar_pop(a, y) * count(a) AS ay,
    regr_sxx(y, a) FILTER (b IS NOT NULL) AS caa, regr_syy(y, a) FILTER (b IS NOT NULL) AS cyy, regr_sxx(y, b) AS cbb,
    covar_pop(a, b) * count(b) AS cab, covar_pop(b, y) * count(b) AS cby, covar_pop(a, y) FILTER (b IS NOT NULL) * count(b) AS cay
  FROM terms GROUP BY 1),
solved AS (
  SELECT *, caa * cbb - cab * cab AS det, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) AS beta,
    cyy - (cay * cbb - cby * cab) / (caa * cbb - cab * cab) * cay - (cby * caa - cay * cab) / (caa * cbb - cab * cab) * cby AS rss1,
    cyy - cay * cay / caa AS rss0, yy - ay * ay / aa AS rss FROM sums),
tested AS (
  SELECT series_id, CASE WHEN m * ln(rss1 / m) + 2 < m * ln(rss0 / m) THEN 1 ELSE 0 END AS adf_lags,
    beta / sqrt(rss1 / (m - 3) * cbb / det) AS one, ay / aa / sqrt(rss / (n - 2) / aa) AS none, m, n FROM solved),
scored AS (SELECT series_id, adf_lags, CASE WHEN adf_lags = 1 THEN one ELSE none END AS t, CASE WHEN adf_lags = 1 THEN m ELSE n END AS nobs FROM tested)
SELECT series_id, round(t, 6) AS adf_stat, adf_lags, nobs,
  t <= -18.83 OR (t < 2.74 AND CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t
    ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END < -1.6448536269514722) AS stationary
FROM scored""",
)
def stationarity_one_lag(spark, sf_dir):
    """The test with none or one lagged change, whichever has the lower AIC."""
    rows = diagnostics.stationarity_test(settle(user_hourly(spark, sf_dir)), KEY, max_lag=1)
    return rows.select(*KEY, rounded("adf_stat").alias("adf_stat"), "adf_lags", "nobs", "stationary")


@register(
    "seasonal_decompose",
    f"""WITH {USER_HOURLY},
trended AS (
  SELECT series_id, pos, value,
    CASE WHEN count(value) OVER f = 25
         THEN (sum(value) OVER f - 0.5::DOUBLE * (lag(value, 12) OVER o + lead(value, 12) OVER o)) / 24.0::DOUBLE END AS trend
  FROM user_hourly WINDOW o AS (PARTITION BY series_id ORDER BY pos), f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
effects AS (SELECT series_id, pos % 24 AS phase, avg(value - trend) AS effect FROM trended GROUP BY 1, 2),
seasons AS (SELECT series_id, phase, effect - avg(effect) OVER (PARTITION BY series_id) AS seasonal FROM effects)
SELECT t.series_id, t.pos, {steady_sql('trend')} AS trend, {steady_sql('seasonal')} AS seasonal, {steady_sql('value - trend - seasonal')} AS resid
FROM trended t JOIN seasons s ON s.series_id = t.series_id AND s.phase = t.pos % 24""",
)
def seasonal_decompose(spark, sf_dir):
    rows = diagnostics.seasonal_decompose(user_hourly(spark, sf_dir), KEY, 24, chunk=CHUNK)
    return rows.select(*KEY, "pos", *[steady(c).alias(c) for c in ("trend", "seasonal", "resid")])


@register(
    "ar_fit",
    f"""WITH {USER_HOURLY}, {AR1_SQL.format('user_hourly')}
SELECT series_id, round(phi, 6) AS phi, round(intercept, 6) AS intercept, n_pairs FROM ar1""",
)
def ar_fit(spark, sf_dir):
    rows = arima.ar1_fit(user_hourly(spark, sf_dir), KEY, chunk=CHUNK)
    return rows.select(*KEY, rounded("phi").alias("phi"), rounded("intercept").alias("intercept"), "n_pairs")


def rounded_params(models):
    return models.select(
        *KEY,
        "model",
        F.array_join("order", ",").alias("order"),
        F.transform("params", lambda v: F.round(v, 4)).alias("params"),
        rounded("sigma2", 4).alias("sigma2"),
        rounded("aic", 4).alias("aic"),
        "n",
        "status",
    )


@register("arima_fit")
def arima_fit(spark, sf_dir):
    """ARIMA(1,1,1) for every user, behind the stationarity gate."""
    return rounded_params(arima.arima_fit(settle(user_hourly(spark, sf_dir)), KEY, (1, 1, 1)))


def css_sql(lag: int, name: str = "fitted") -> str:
    """Conditional least squares of one autoregressive term on changes over ``lag`` rows, zero before the first."""
    return f"""{name}_changes AS (
  SELECT series_id, pos, w FROM (
    SELECT series_id, pos, value - lag(value, {lag}) OVER (PARTITION BY series_id ORDER BY pos) AS w FROM user_hourly) WHERE w IS NOT NULL),
{name}_paired AS (SELECT series_id, pos, w, lag(w) OVER (PARTITION BY series_id ORDER BY pos) AS before FROM {name}_changes),
{name}_sums AS (
  SELECT series_id, count(*) AS n, sum(w * w) AS ww, sum(w * before) AS wb, sum(before * before) AS bb, max_by(w, pos) AS w_last
  FROM {name}_paired GROUP BY 1),
{name} AS (SELECT *, wb / bb AS phi, (ww - wb / bb * wb) / n AS sigma2 FROM {name}_sums)"""


ONE_CHANGE, DAY_CHANGE = css_sql(1), css_sql(24)
FITTED = """SELECT series_id, round(phi, 6) AS phi, round(sigma2, 4) AS sigma2,
  round(n * (ln(2 * pi() * sigma2) + 1) + 4, 4) AS aic, n, 'ok' AS status FROM fitted"""


def one_term(models):
    return models.select(
        *KEY,
        rounded(F.col("params")[0]).alias("phi"),
        rounded("sigma2", 4).alias("sigma2"),
        rounded("aic", 4).alias("aic"),
        "n",
        "status",
    )


@register("arima_fit_ar", f"WITH {USER_HOURLY}, {ONE_CHANGE} {FITTED}")
def arima_fit_ar(spark, sf_dir):
    """ARIMA(1,1,0) for every user."""
    rows = settle(user_hourly(spark, sf_dir))
    return one_term(arima.arima_fit(rows, KEY, (1, 1, 0), gate=False, chunk=CHUNK))


@register(
    "arima_forecast_ar",
    f"""WITH {USER_HOURLY}, {ONE_CHANGE},
ends AS (SELECT series_id, max(ts) AS last, max_by(value, pos) AS y FROM user_hourly GROUP BY 1)
SELECT series_id, step, last + step * INTERVAL 1 HOUR AS ts, round(y + w_last * phi * (1 - pow(phi, step)) / (1 - phi), 4) AS yhat
FROM fitted JOIN ends USING (series_id) CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS step)""",
)
def arima_forecast_ar(spark, sf_dir):
    rows = settle(user_hourly(spark, sf_dir))
    models = arima.arima_fit(rows, KEY, (1, 1, 0), gate=False)
    return arima.forecast_stored(models, KEY, 24).select(*KEY, "step", "ts", rounded("yhat", 4).alias("yhat"))


@register("arima_forecast")
def arima_forecast(spark, sf_dir):
    """24 hours of every fitted user, from the stored end states alone."""
    models = arima.arima_fit(settle(user_hourly(spark, sf_dir)), KEY, (1, 1, 1))
    out = arima.forecast_stored(models, KEY, 24)
    return out.select(*KEY, "model", "step", "ts", rounded("yhat", 4).alias("yhat"))


@register(
    "ar1_forecast",
    f"""WITH {USER_HOURLY}, {AR1_SQL.format('user_hourly')},
ends AS (SELECT series_id, max(ts) AS last, max_by(value, pos) AS y FROM user_hourly GROUP BY 1)
SELECT series_id, step, last + step * INTERVAL 1 HOUR AS ts,
  round(intercept / (1 - phi) + pow(phi, step) * (y - intercept / (1 - phi)), 6) AS yhat
FROM ar1 JOIN ends USING (series_id) CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS step)""",
)
def ar1_forecast(spark, sf_dir):
    rows = user_hourly(spark, sf_dir)
    out = arima.ar1_forecast(rows, arima.ar1_fit(rows, KEY, chunk=CHUNK), KEY, 24)
    return out.select(*KEY, "step", "ts", rounded("yhat").alias("yhat"))


# ---- 76-79 seasonal models ------------------------------------------------------------------

ORDERS = ((1, 1, 1), (2, 0, 0))
SEASONAL_ORDERS = ((1, 0, 0, 24),)


def driven(spark, sf_dir):
    """Hourly event types with the all-type total of the hour as a regressor, built once."""
    rows = hourly(spark, sf_dir)
    totals = rows.groupBy("pos").agg(F.sum("value").alias("total"))
    return settle(rows.join(totals, "pos"))


@register("sarimax_grid_fit")
def sarimax_grid_fit(spark, sf_dir):
    models = arima.sarimax_grid_fit(driven(spark, sf_dir), KEY, ORDERS, SEASONAL_ORDERS, exog=["total"])
    return rounded_params(models)


@register("sarimax_forecast")
def sarimax_forecast(spark, sf_dir):
    rows = driven(spark, sf_dir)
    models = arima.sarimax_grid_fit(rows, KEY, ORDERS, SEASONAL_ORDERS, exog=["total"])
    best = selection.best_by_aic(models, KEY)
    future = arima.repeated_regressors(rows, KEY, 10, ["total"])
    out = arima.forecast_stored(best, KEY, 10, ["total"], future)
    return out.select(*KEY, "step", "ts", rounded("yhat", 4).alias("yhat"))


SEASONAL = ((1, 0, 0),), ((0, 1, 0, 24),)


@register("sarimax_fit_seasonal", f"WITH {USER_HOURLY}, {DAY_CHANGE} {FITTED}")
def sarimax_fit_seasonal(spark, sf_dir):
    """SARIMAX (1,0,0)(0,1,0,24) for every user."""
    return one_term(arima.sarimax_grid_fit(settle(user_hourly(spark, sf_dir)), KEY, *SEASONAL, chunk=CHUNK))


@register(
    "sarimax_forecast_seasonal",
    f"""WITH {USER_HOURLY}, {DAY_CHANGE},
ends AS (SELECT series_id, max(ts) AS last, max(pos) AS last_pos FROM user_hourly GROUP BY 1)
SELECT e.series_id, step, last + step * INTERVAL 1 HOUR AS ts, round(u.value + pow(phi, step) * w_last, 4) AS yhat
FROM ends e JOIN fitted f ON f.series_id = e.series_id CROSS JOIN (SELECT unnest(generate_series(1, 10)) AS step)
JOIN user_hourly u ON u.series_id = e.series_id AND u.pos = last_pos + step - 24""",
)
def sarimax_forecast_seasonal(spark, sf_dir):
    models = arima.sarimax_grid_fit(settle(user_hourly(spark, sf_dir)), KEY, *SEASONAL)
    return arima.forecast_stored(models, KEY, 10).select(*KEY, "step", "ts", rounded("yhat", 4).alias("yhat"))


@register(
    "best_by_aic",
    f"""WITH {USER_HOURLY}, {AR1_SQL.format('user_hourly')},
errors AS (
  SELECT u.series_id, count(*) AS n, sum(pow(u.value - a.intercept - a.phi * u.before, 2)) AS ar, sum(pow(u.value - u.before, 2)) AS walk
  FROM (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS before FROM user_hourly) u
  JOIN ar1 a USING (series_id) WHERE before IS NOT NULL GROUP BY 1),
scored AS (
  SELECT series_id, 'ar1' AS model, n * ln(ar / n) + 4 AS aic FROM errors
  UNION ALL SELECT series_id, 'walk', n * ln(walk / n) FROM errors)
SELECT series_id, arg_min(model, aic) AS model, round(min(aic), 4) AS aic FROM scored GROUP BY 1""",
)
def best_by_aic(spark, sf_dir):
    """AR(1) against the random walk, on a candidate table made with aggregates."""
    rows = user_hourly(spark, sf_dir)
    models = arima.ar1_fit(rows, KEY, chunk=CHUNK)
    pairs = attach(lag1(rows, ["value"], KEY, chunk=CHUNK), models, KEY).filter(F.col("value_lag1").isNotNull())
    ar = F.col("value") - F.col("intercept") - F.col("phi") * F.col("value_lag1")
    walk = F.col("value") - F.col("value_lag1")
    sums = pairs.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.sum(ar * ar).alias("ar"), F.sum(walk * walk).alias("walk")
    )
    n = F.col("n")
    candidates = sums.select(
        *KEY,
        F.explode(
            F.array(
                F.struct(F.lit("ar1").alias("model"), F.array(F.lit(1)).alias("order"), (n * F.log(F.col("ar") / n) + 4).alias("aic")),
                F.struct(F.lit("walk").alias("model"), F.array(F.lit(0)).alias("order"), (n * F.log(F.col("walk") / n)).alias("aic")),
            )
        ).alias("_c"),
    ).select(*KEY, "_c.*")
    return selection.best_by_aic(candidates, KEY).select(*KEY, "model", rounded("aic", 4).alias("aic"))


@register(
    "future_index",
    f"""WITH {DAILY}, ends AS (SELECT series_id, max(ts) AS last FROM daily GROUP BY 1)
SELECT series_id, step, last + step * INTERVAL 1 DAY AS ts FROM ends CROSS JOIN (SELECT unnest(generate_series(1, 30)) AS step)""",
)
def future_index_query(spark, sf_dir):
    return future_index(daily(spark, sf_dir), KEY, 30, DAY)


# ---- 80-83 window forecaster, choice, requests ----------------------------------------------


def hold_out(rows):
    """Training rows, and the rows that windows of the hold-out may touch."""
    sized = with_length(rows, KEY)
    border = fraction(F.col("n_rows"), 0.8)
    train = sized.filter(F.col("pos") < border).drop("n_rows")
    rest = sized.withColumn("first", border - 24).drop("n_rows")
    return train, rest


@register("window_linear_forecast")
def window_linear_forecast(spark, sf_dir):
    """24 hours to the next 6, fit on four fifths of every user, scored on the rest."""
    rows = settle(user_hourly(spark, sf_dir))
    train, rest = hold_out(rows)
    models = linear.window_linear_fit(train, KEY, 24, 6, penalty=1e-3)
    windows = cut_windows(rest.filter(F.col("pos") >= F.col("first")), ["value"], KEY, 24, 6, stride=6, first="first", chunk=CHUNK)
    scored = linear.window_linear_predict(windows, models, KEY)
    return scored.select(*KEY, "window_id", "step", "value", rounded("yhat", 4).alias("yhat"))


@register(
    "window_linear_step",
    f"""WITH {USER_HOURLY}, {AR1_SQL.format('user_hourly')}
SELECT series_id, round(phi, 6) AS weight, round(intercept, 6) AS intercept, n_pairs AS n_windows FROM ar1""",
)
def window_linear_step(spark, sf_dir):
    """One hour to the next: the window forecaster's smallest case is the AR(1) regression."""
    models = linear.window_linear_fit(user_hourly(spark, sf_dir), KEY, 1, 1, penalty=0.0)
    return models.select(
        *KEY,
        rounded(F.col("coefs")[0][0]).alias("weight"),
        rounded(F.col("intercepts")[0]).alias("intercept"),
        "n_windows",
    )


WINDOW_TWO = """windows AS (
  SELECT series_id, lag(value) OVER o AS a, value AS b, lead(value, 1) OVER o AS y1, lead(value, 2) OVER o AS y2
  FROM user_hourly WINDOW o AS (PARTITION BY series_id ORDER BY pos)),
pairs AS (
  SELECT series_id, step, a, b, CASE step WHEN 1 THEN y1 ELSE y2 END AS y
  FROM windows CROSS JOIN (VALUES (1), (2)) s(step) WHERE a IS NOT NULL AND y2 IS NOT NULL),
sums AS (
  SELECT series_id, step, count(*) AS n, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
    avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM pairs GROUP BY 1, 2),
solved AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS older, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS newer FROM sums),
window_ends AS (SELECT series_id, max(ts) AS last, max_by(value, pos) AS b, max_by(value, pos) FILTER (later) AS a FROM (
  SELECT *, lead(pos) OVER (PARTITION BY series_id ORDER BY pos) IS NOT NULL AS later FROM user_hourly) GROUP BY 1)"""


@register(
    "window_linear_two",
    f"""WITH {USER_HOURLY}, {WINDOW_TWO}
SELECT s.series_id, s.step, round(older, 6) AS older, round(newer, 6) AS newer, round(my - older * ma - newer * mb, 6) AS intercept,
  n AS n_windows, last + s.step * INTERVAL 1 HOUR AS ts, round(older * a + newer * b + my - older * ma - newer * mb, 4) AS yhat
FROM solved s JOIN window_ends e ON e.series_id = s.series_id""",
)
def window_linear_two(spark, sf_dir):
    """Two hours to the next two: weights, and the forecast from the last two hours."""
    rows = settle(user_hourly(spark, sf_dir))
    models = linear.window_linear_fit(rows, KEY, 2, 2, penalty=0.0, chunk=CHUNK)
    paths = linear.window_linear_forecast(rows, models, KEY, 2)
    steps = models.select(*KEY, "n_windows", F.posexplode(F.arrays_zip("coefs", "intercepts")).alias("at", "w"))
    steps = steps.withColumn("step", F.col("at") + 1).join(paths, [*KEY, "step"])
    return steps.select(
        *KEY,
        "step",
        rounded(F.col("w.coefs")[0]).alias("older"),
        rounded(F.col("w.coefs")[1]).alias("newer"),
        rounded("w.intercepts").alias("intercept"),
        "n_windows",
        "ts",
        rounded("yhat", 4).alias("yhat"),
    )


BACKTEST = f"""{USER_HOURLY}, sized AS (SELECT series_id, count(*) AS n FROM user_hourly GROUP BY 1),
train AS (SELECT u.series_id, u.pos, u.value FROM user_hourly u JOIN sized USING (series_id) WHERE pos < floor(n::DOUBLE * 0.8::DOUBLE)),
changes AS (SELECT series_id, pos, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS value FROM train),
{AR1_SQL.format('train')},
{AR1_SQL.format('changes').replace('ar1 AS', 'ari AS', 1).replace('FROM (SELECT series_id, value,', 'FROM (SELECT series_id, value, ')},
ends AS (SELECT series_id, max(pos) AS last, max_by(value, pos) AS y FROM train GROUP BY 1),
end_change AS (SELECT series_id, max_by(value, pos) AS w FROM changes GROUP BY 1),
test AS (SELECT u.series_id, u.pos - e.last AS step, u.value FROM user_hourly u JOIN ends e ON e.series_id = u.series_id AND u.pos > e.last),
paths AS (
  SELECT t.series_id, 'arima(1,0,0)' AS model, t.step, t.value,
    a.intercept / (1 - a.phi) + pow(a.phi, t.step) * (e.y - a.intercept / (1 - a.phi)) AS yhat
  FROM test t JOIN ends e USING (series_id) JOIN ar1 a USING (series_id)
  UNION ALL
  SELECT t.series_id, 'arima(1,1,0)', t.step, t.value,
    e.y + sum(a.intercept / (1 - a.phi) + pow(a.phi, t.step) * (c.w - a.intercept / (1 - a.phi))) OVER (PARTITION BY t.series_id ORDER BY t.step)
  FROM test t JOIN ends e USING (series_id) JOIN end_change c USING (series_id) JOIN ari a USING (series_id)),
scores AS (SELECT series_id, model, sqrt(avg(pow(value - yhat, 2))) AS rmse FROM paths GROUP BY 1, 2)"""


def backtest_scores(spark, sf_dir):
    """Hold-out RMSE of two autoregressions per user: on levels and on changes."""
    rows = with_length(settle(user_hourly(spark, sf_dir)), KEY)
    border = fraction(F.col("n_rows"), 0.8)
    train = rows.filter(F.col("pos") < border)
    test = rows.filter(F.col("pos") >= border).select(*KEY, (F.col("pos") - border + 1).alias("step"), "value")
    sizes = rows.groupBy(*KEY).agg(F.first(F.col("n_rows") - border).alias("horizon"))
    paths = None
    for d in (0, 1):
        base = arima.differenced(train, ["value"], KEY, d, chunk=CHUNK) if d else train
        models = attach(arima.ar1_fit(base, KEY, chunk=CHUNK), sizes, KEY)
        ends = base.withColumn("ts", F.lit(None).cast("timestamp_ntz")) if "ts" not in base.columns else base
        path = arima.ar1_forecast(ends, models, KEY, "horizon").drop("ts")
        if d:
            last = train.groupBy(*KEY).agg(F.max_by("value", "pos").alias("_y"))
            running = F.sum("yhat").over(Window.partitionBy(*KEY).orderBy("step"))
            path = attach(path.withColumn("yhat", running), last, KEY)
            path = path.withColumn("yhat", F.col("_y") + F.col("yhat")).drop("_y")
        path = path.withColumn("model", F.lit(f"arima(1,{d},0)"))
        paths = path if paths is None else paths.unionByName(path)
    error = F.col("value") - F.col("yhat")
    scored = paths.join(test, [*KEY, "step"]).groupBy(*KEY, "model")
    return scored.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


@register(
    "model_select",
    f"""WITH {BACKTEST}
SELECT series_id, arg_min(model, rmse) AS model, round(min(rmse), 4) AS rmse FROM scores GROUP BY 1""",
)
def model_select(spark, sf_dir):
    best = selection.model_select(backtest_scores(spark, sf_dir), KEY)
    return best.select(*KEY, "model", rounded("rmse", 4).alias("rmse"))


@register("window_linear_channels")
def window_linear_channels(spark, sf_dir):
    """All channels of the hour to all channels of the next three, with the hour of day known ahead."""
    angle = F.hour("ts") * F.lit(2 * math.pi / 24)
    table = wide(spark, sf_dir, fill=0.0)
    names = table.columns[2:]
    rows = settle(table.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "series_id": F.lit("all")}))
    marks = ["hour_sin", "hour_cos"]
    models = linear.window_linear_fit(rows, KEY, 6, 3, target=names, penalty=1e-6, chunk=CHUNK, marks=marks)
    windows = cut_windows(rows, [*names, *marks], KEY, 6, 3, stride=3, chunk=CHUNK)
    scored = linear.window_linear_predict(windows, models, KEY, names, names, marks, keep_failed=True)
    return scored.select(*KEY, "window_id", "channel", "step", "value", rounded("yhat", 4).alias("yhat"), "status")


FOLDS = f"""{USER_HOURLY}, sized AS (SELECT series_id, count(*) AS n FROM user_hourly GROUP BY 1),
folds AS (
  SELECT series_id, fold, CAST(floor(n::DOUBLE * share::DOUBLE) AS BIGINT) AS origin FROM sized CROSS JOIN (VALUES (0, 0.6), (1, 0.7), (2, 0.8)) s(fold, share)),
lagged AS (
  SELECT series_id, pos, value, lag(value) OVER o AS b1, lag(value, 24) OVER o AS b24 FROM user_hourly WINDOW o AS (PARTITION BY series_id ORDER BY pos)),
changed AS (
  SELECT *, value - b1 AS w1, value - b24 AS w24, lag(value - b1) OVER o AS v1, lag(value - b24) OVER o AS v24
  FROM lagged WINDOW o AS (PARTITION BY series_id ORDER BY pos)),
fits AS (
  SELECT f.series_id, fold, origin, regr_slope(value, b1) AS phi, regr_intercept(value, b1) AS c, sum(w1 * v1) / sum(v1 * v1) AS phi1,
    sum(w24 * v24) / sum(v24 * v24) AS phi24, max_by(value, pos) AS y, max_by(w1, pos) AS w1, max_by(w24, pos) AS w24
  FROM folds f JOIN changed x ON x.series_id = f.series_id AND x.pos < origin GROUP BY 1, 2, 3),
ahead AS (
  SELECT t.*, u.pos - origin + 1 AS step, u.value, before.value AS day_before
  FROM fits t JOIN user_hourly u ON u.series_id = t.series_id AND u.pos >= origin AND u.pos < origin + 24
  JOIN user_hourly before ON before.series_id = t.series_id AND before.pos = u.pos - 24),
paths AS (
  SELECT series_id, fold, 'ar(1)' AS model, value, c / (1 - phi) + pow(phi, step) * (y - c / (1 - phi)) AS yhat FROM ahead
  UNION ALL SELECT series_id, fold, 'arima(1,1,0)', value, y + w1 * phi1 * (1 - pow(phi1, step)) / (1 - phi1) FROM ahead
  UNION ALL SELECT series_id, fold, 'arima(1,0,0)(0,1,0,24)', value, day_before + pow(phi24, step) * w24 FROM ahead
  UNION ALL SELECT series_id, fold, 'repeat(24)', value, day_before FROM ahead)"""
CANDIDATES = [backtest.Autoregression(1), backtest.Arima((1, 1, 0)), backtest.Arima((1, 0, 0), (0, 1, 0, 24)), backtest.Repeat(24)]


def rolling_folds(spark, sf_dir):
    return backtest.backtest(settle(user_hourly(spark, sf_dir)), CANDIDATES, KEY, 24, (0.6, 0.7, 0.8), chunk=CHUNK)


@register(
    "rolling_backtest",
    f"""WITH {FOLDS}
SELECT series_id, model, fold, count(*) AS steps, round(sum(pow(value - yhat, 2)), 4) AS squares FROM paths GROUP BY 1, 2, 3""",
)
def rolling_backtest(spark, sf_dir):
    """Four families on three rolling origins of every user, a day ahead each."""
    rows = rolling_folds(spark, sf_dir)
    return rows.select(*KEY, "model", "fold", F.col("steps").cast("long").alias("steps"), rounded("squares", 4).alias("squares"))


@register(
    "model_select_rolling",
    f"""WITH {FOLDS}, scores AS (SELECT series_id, model, {steady_sql('sqrt(avg(pow(value - yhat, 2)))')} AS rmse FROM paths GROUP BY 1, 2)
SELECT series_id, model, rmse FROM scores QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) = 1""",
)
def model_select_rolling(spark, sf_dir):
    """The family with the lowest error over all origins; the first by name of equal ones."""
    scores = backtest.backtest_scores(rolling_folds(spark, sf_dir), KEY)
    return selection.model_select(scores.withColumn("rmse", steady("rmse")), KEY)


@register(
    "forecast_requests",
    f"""WITH {HOURLY}, {AR1_SQL.format('hourly')},
requests AS (
  SELECT event_id AS request_id, CASE WHEN event_id % 13 = 5 THEN 'refund' ELSE event_type END AS series_id,
    CASE event_id % 4 WHEN 0 THEN 'transformer' ELSE 'ar1' END AS model, 1 + user_id % 30 AS horizon FROM events),
ends AS (SELECT series_id, max(ts) AS last, max_by(value, pos) AS y FROM hourly GROUP BY 1),
known AS (SELECT DISTINCT series_id FROM hourly)
SELECT request_id, r.series_id, r.model, r.horizon,
  CASE WHEN k.series_id IS NOT NULL AND r.model = 'ar1' AND horizon <= 24 THEN 'result' ELSE 'error' END AS status,
  CASE WHEN k.series_id IS NULL THEN 'unknown series' WHEN r.model <> 'ar1' THEN 'no such model'
       WHEN horizon > 24 THEN 'no forecast at this horizon' END AS error,
  CASE WHEN r.model = 'ar1' AND horizon <= 24 THEN last + horizon * INTERVAL 1 HOUR END AS ts,
  CASE WHEN r.model = 'ar1' AND horizon <= 24 THEN round(intercept / (1 - phi) + pow(phi, horizon) * (y - intercept / (1 - phi)), 6) END AS yhat
FROM requests r LEFT JOIN known k ON k.series_id = r.series_id
LEFT JOIN ar1 a ON a.series_id = r.series_id LEFT JOIN ends e ON e.series_id = r.series_id""",
)
def forecast_requests(spark, sf_dir):
    """Every event asks for a forecast; some name an unknown series, model or horizon."""
    requests = events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 13 == 5, "refund").otherwise(F.col("event_type")).alias("series_id"),
        F.when(F.col("event_id") % 4 == 0, "transformer").otherwise("ar1").alias("model"),
        (F.lit(1) + F.col("user_id") % 30).alias("horizon"),
    )
    rows = hourly(spark, sf_dir)
    models = arima.ar1_fit(rows, KEY, chunk=CHUNK).withColumn("model", F.lit("ar1"))
    forecasts = arima.ar1_forecast(rows, models, KEY, 24).withColumn("model", F.lit("ar1"))
    answers = selection.forecast_requests(requests, rows, models, forecasts)
    return answers.withColumn("yhat", rounded("yhat"))


@register(
    "forecast_requests_routed",
    f"""WITH {USER_HOURLY}, {AR1_SQL.format('user_hourly')}, {css_sql(1, "hour")}, {css_sql(24, "season")}, {WINDOW_TWO},
requests AS (
  SELECT event_id AS request_id, CASE WHEN event_id % 13 = 5 THEN -1 ELSE user_id END AS series_id,
    CASE event_id % 5 WHEN 0 THEN 'ar1' WHEN 1 THEN 'arima' WHEN 2 THEN 'sarimax' WHEN 3 THEN 'window' ELSE 'transformer' END AS model,
    event_id // 7 % 25 AS horizon FROM events),
ends AS (SELECT series_id, max(ts) AS last, max(pos) AS last_pos, max_by(value, pos) AS y FROM user_hourly GROUP BY 1),
answers AS (
  SELECT r.*, e.last + horizon * INTERVAL 1 HOUR AS due, e.series_id IS NOT NULL AS known,
    CASE model WHEN 'ar1' THEN intercept / (1 - a.phi) + pow(a.phi, horizon) * (y - intercept / (1 - a.phi))
      WHEN 'arima' THEN y + h.w_last * h.phi * (1 - pow(h.phi, horizon)) / (1 - h.phi)
      WHEN 'sarimax' THEN u.value + pow(s.phi, horizon) * s.w_last
      WHEN 'window' THEN older * w.a + newer * w.b + my - older * ma - newer * mb END AS path
  FROM requests r LEFT JOIN ends e ON e.series_id = r.series_id LEFT JOIN ar1 a ON a.series_id = r.series_id
  LEFT JOIN hour h ON h.series_id = r.series_id LEFT JOIN season s ON s.series_id = r.series_id
  LEFT JOIN user_hourly u ON u.series_id = r.series_id AND u.pos = last_pos + horizon - 24
  LEFT JOIN solved v ON v.series_id = r.series_id AND v.step = horizon LEFT JOIN window_ends w ON w.series_id = r.series_id),
judged AS (
  SELECT *, CASE WHEN NOT known THEN 'unknown series' WHEN model = 'transformer' THEN 'no such model' WHEN horizon <= 0 THEN 'horizon must be positive'
    WHEN path IS NULL THEN 'no forecast at this horizon' END AS error FROM answers)
SELECT request_id, series_id, model, horizon, CASE WHEN error IS NULL THEN 'result' ELSE 'error' END AS status, error,
  CASE WHEN error IS NULL THEN due END AS ts, CASE WHEN error IS NULL THEN round(path, 4) END AS yhat FROM judged""",
)
def forecast_requests_routed(spark, sf_dir):
    """Every event asks one of four families for its user; the models come from a new store, fitted as asked for."""
    number = F.col("event_id")
    family = F.element_at(F.array(*[F.lit(m) for m in ("ar1", "arima", "sarimax", "window", "transformer")]), (number % 5 + 1).cast("int"))
    requests = events(spark, sf_dir).select(
        number.alias("request_id"),
        F.when(number % 13 == 5, F.lit(-1)).otherwise(F.col("user_id")).alias("series_id"),
        family.alias("model"),
        (F.floor(number / 7) % 25).alias("horizon"),
    )
    families = {
        "ar1": serving.ar1_family(chunk=CHUNK),
        "arima": serving.arima_family((1, 1, 0), gate=False),
        "sarimax": serving.sarimax_family(*SEASONAL),
        "window": serving.window_family(2, 2, penalty=0.0, chunk=CHUNK),
    }
    answers = serving.answer_requests(requests, settle(user_hourly(spark, sf_dir)), families, fresh_path(spark, "store"), KEY)
    return answers.withColumn("yhat", rounded("yhat", 4))


@register(
    "complete_horizons",
    f"""WITH {HOURLY_GAPS}, predicted AS (
  SELECT series_id, pos // 6 AS window_id, pos % 6 + 1 AS step, value AS yhat FROM hourly WHERE value IS NOT NULL)
SELECT series_id, window_id, step, yhat FROM predicted
QUALIFY count(*) OVER (PARTITION BY series_id, window_id) = 6""",
)
def complete_horizons_query(spark, sf_dir):
    rows = hourly(spark, sf_dir, fill=None).filter(F.col("value").isNotNull())
    predicted = rows.select(
        *KEY,
        F.floor(F.col("pos") / F.lit(6)).alias("window_id"),
        (F.col("pos") % 6 + 1).alias("step"),
        F.col("value").alias("yhat"),
    )
    return complete_horizons(predicted, [*KEY, "window_id"], 6)
