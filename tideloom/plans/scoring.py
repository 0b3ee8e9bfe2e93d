"""Queries for evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tideloom.functions.times import HOUR, shift
from tideloom.models.arima import ar1_fit, ar1_forecast
from tideloom.operators import evaluation
from tideloom.operators.ordering import attach, with_length
from tideloom.operators.splits import fraction
from tideloom.plans.base import CHUNK, HOURLY, KEY, USER_HOURLY, hourly, rounded, steady, steady_sql, user_hourly
from tideloom.plans.preparation import AR1_SQL
from tideloom.plans.registry import register

# ---- the flagship: resample, split, fit, forecast, score ------------------------------------

FLAGSHIP = f"""{HOURLY}, sized AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY 1),
train AS (SELECT h.* FROM hourly h JOIN sized USING (series_id) WHERE pos < floor(n::DOUBLE * 0.8::DOUBLE)),
{AR1_SQL.format('train')},
ends AS (SELECT series_id, max(ts) AS last, max(pos) AS last_pos, max_by(value, pos) AS y FROM train GROUP BY 1),
paths AS (
  SELECT h.series_id, h.pos - e.last_pos AS step, h.ts, h.value,
    a.intercept / (1 - a.phi) + pow(a.phi, h.pos - e.last_pos) * (e.y - a.intercept / (1 - a.phi)) AS yhat
  FROM hourly h JOIN ends e ON e.series_id = h.series_id AND h.pos > e.last_pos JOIN ar1 a ON a.series_id = h.series_id)"""


def hold_out_forecast(spark, sf_dir):
    """The last fifth of every hourly series and the AR(1) forecast of it."""
    rows = with_length(hourly(spark, sf_dir), KEY)
    border = fraction(F.col("n_rows"), 0.8)
    train, test = rows.filter(F.col("pos") < border), rows.filter(F.col("pos") >= border)
    sizes = test.groupBy(*KEY).agg(F.count("*").alias("horizon"))
    models = attach(ar1_fit(train, KEY, chunk=CHUNK), sizes, KEY)
    forecast = ar1_forecast(train, models, KEY, "horizon")
    return test.withColumn("step", F.col("pos") - border + 1), forecast


@register(
    "mse_aligned",
    f"WITH {FLAGSHIP} SELECT series_id, round(avg(pow(value - yhat, 2)), 6) AS mse, count(*) AS n FROM paths GROUP BY 1",
)
def mse_aligned(spark, sf_dir):
    test, forecast = hold_out_forecast(spark, sf_dir)
    rows = evaluation.mse_aligned(test, forecast, KEY)
    return rows.select(*KEY, rounded("mse").alias("mse"), "n")


@register(
    "mse_positional",
    f"""WITH {FLAGSHIP}
SELECT series_id, round(avg(pow(value - yhat, 2)), 6) AS mse, count(*) AS n FROM paths GROUP BY 1""",
)
def mse_positional(spark, sf_dir):
    test, forecast = hold_out_forecast(spark, sf_dir)
    rows = evaluation.mse_positional(test, forecast, KEY)
    return rows.select(*KEY, rounded("mse").alias("mse"), "n")


# ---- scores of yesterday's value as the forecast, for every user and day --------------------

PAIRS = f"""{USER_HOURLY}, pairs AS (
  SELECT now.series_id, now.pos // 24 AS day, now.pos % 24 + 1 AS step, now.ts, now.value, before.value AS yhat
  FROM user_hourly now JOIN user_hourly before ON before.series_id = now.series_id AND before.pos = now.pos - 24)"""


def pairs(spark, sf_dir):
    rows = user_hourly(spark, sf_dir)
    before = rows.select(*KEY, (F.col("pos") + 24).alias("pos"), F.col("value").alias("yhat"))
    both = rows.join(before, [*KEY, "pos"])
    day = F.floor(F.col("pos") / F.lit(24)).alias("day")
    return both.select(*KEY, day, (F.col("pos") % 24 + 1).alias("step"), "ts", "value", "yhat")


@register(
    "metrics5",
    f"""WITH {PAIRS}
SELECT series_id, {steady_sql('avg(abs(yhat - value))')} AS mae, {steady_sql('avg(pow(yhat - value, 2))')} AS mse,
  {steady_sql('sqrt(avg(pow(yhat - value, 2)))')} AS rmse, {steady_sql('avg(abs((yhat - value) / nullif(value, 0)))')} AS mape,
  {steady_sql('avg(pow((yhat - value) / nullif(value, 0), 2))')} AS mspe, count(*) AS n, count(nullif(value, 0)) AS n_relative
FROM pairs GROUP BY 1""",
)
def metrics5(spark, sf_dir):
    rows = evaluation.metrics5(pairs(spark, sf_dir), KEY)
    scores = [steady(c).alias(c) for c in ("mae", "mse", "rmse", "mape", "mspe")]
    return rows.select(*KEY, *scores, "n", "n_relative")


def losses(spark, sf_dir):
    """Mean squared error per user and day."""
    rows = evaluation.window_mse(pairs(spark, sf_dir), [*KEY, "day"])
    return rows.withColumn("loss", steady("loss"))


LOSSES = f"""{PAIRS}, losses AS (
  SELECT series_id, day, {steady_sql('avg(pow(value - yhat, 2))')} AS loss FROM pairs GROUP BY 1, 2)"""


@register(
    "topk_window_mse",
    f"WITH {LOSSES} SELECT series_id, day, loss FROM losses ORDER BY loss DESC, series_id, day LIMIT 50",
)
def topk_window_mse(spark, sf_dir):
    rows = evaluation.topk_window_mse(pairs(spark, sf_dir), [*KEY, "day"], 50)
    return rows.withColumn("loss", steady("loss"))


EPOCHS = f"""{LOSSES}, log AS (SELECT series_id, day % 6 AS epoch, series_id // 8 AS batch, series_id * 100 + day AS window_id, loss FROM losses)"""


def loss_log(spark, sf_dir):
    """Window losses laid out as a training log: the day gives the epoch, eight users a batch."""
    return losses(spark, sf_dir).select(
        *KEY,
        (F.col("day") % 6).alias("epoch"),
        F.floor(F.col("series_id") / F.lit(8)).alias("batch"),
        (F.col("series_id") * 100 + F.col("day")).alias("window_id"),
        "loss",
    )


@register(
    "hard_windows_by_epoch",
    f"""WITH {EPOCHS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY epoch, batch ORDER BY loss DESC, window_id) AS rank,
         count(*) OVER (PARTITION BY epoch, batch) AS b FROM log)
SELECT epoch, batch, window_id, rank, loss FROM ranked
WHERE rank <= CASE WHEN epoch < 2 THEN b WHEN epoch < 4 THEN floor(b * (5 - epoch) / (6 - epoch)::DOUBLE) ELSE floor(b * 0.5::DOUBLE) END""",
)
def hard_windows_by_epoch(spark, sf_dir):
    rows = evaluation.hard_windows_by_epoch(loss_log(spark, sf_dir))
    return rows.select("epoch", "batch", "window_id", F.col("rank").cast("bigint").alias("rank"), "loss")


NORMAL = f"""{PAIRS}, normal AS (
  SELECT series_id, day, step, value AS label, yhat AS mu, sqrt(1 + yhat) AS sigma FROM pairs)"""


def normal(spark, sf_dir):
    sigma = F.sqrt(1 + F.col("yhat")).alias("sigma")
    return pairs(spark, sf_dir).select(*KEY, "day", "step", F.col("value").alias("label"), F.col("yhat").alias("mu"), sigma)


def written(sql: str) -> str:
    """The same CTEs, each evaluated once and kept, so that no filter is pushed through their joins."""
    return re.sub(r"(\w+) AS \(\s*SELECT", r"\1 AS MATERIALIZED (SELECT", sql)


@register(
    "gaussian_nll",
    f"""WITH {written(NORMAL)}
SELECT series_id, day, step, round(0.5::DOUBLE * ln(2 * pi()) + ln(sigma) + pow(label - mu, 2) / (2 * sigma * sigma), 6) AS nll,
  round(pow(label - mu, 2), 6) AS se FROM normal WHERE label <> 0""",
)
def gaussian_nll(spark, sf_dir):
    rows = evaluation.gaussian_nll(normal(spark, sf_dir))
    return rows.select(*KEY, "day", "step", rounded("nll").alias("nll"), rounded("se").alias("se"))


@register(
    "gaussian_nll_topk",
    f"""WITH {NORMAL}, scored AS (
  SELECT series_id, day, step, 0.5::DOUBLE * ln(2 * pi()) + ln(sigma) + pow(label - mu, 2) / (2 * sigma * sigma) AS nll,
    pow(label - mu, 2) AS se FROM normal WHERE label >= 0),
both_measures AS (SELECT 'nll' AS measure, nll AS value, * FROM scored UNION ALL SELECT 'se', se, * FROM scored)
SELECT measure, row_number() OVER w AS rank, round(value, 6) AS value FROM both_measures
WINDOW w AS (PARTITION BY measure ORDER BY value DESC, series_id, day, step) QUALIFY row_number() OVER w <= 20""",
)
def gaussian_nll_topk(spark, sf_dir):
    rows = evaluation.gaussian_nll(normal(spark, sf_dir), ignore_zero=False)
    top = evaluation.topk_each(rows, ["nll", "se"], 20, [*KEY, "day", "step"])
    return top.select("measure", F.col("rank").cast("bigint").alias("rank"), rounded("value").alias("value"))


@register(
    "masked_abs_error",
    f"WITH {written(NORMAL)} SELECT series_id, day, step, round(abs(label - mu), 6) AS ae FROM normal WHERE label <> 0",
)
def masked_abs_error(spark, sf_dir):
    rows = evaluation.masked_abs_error(normal(spark, sf_dir))
    return rows.select(*KEY, "day", "step", rounded("ae").alias("ae"))


@register(
    "best_epoch",
    f"""WITH {LOSSES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY loss, day) AS r FROM losses)
SELECT series_id, day AS epoch, loss AS mse FROM ranked WHERE r = 1""",
)
def best_epoch(spark, sf_dir):
    log = losses(spark, sf_dir).select(*KEY, F.col("day").alias("epoch"), F.col("loss").alias("mse"))
    return evaluation.best_epoch(log, KEY)


@register(
    "repeat_mean",
    f"""WITH {PAIRS}, runs AS (SELECT series_id, day, avg(pow(value - yhat, 2)) AS mse, avg(abs(value - yhat)) AS mae FROM pairs GROUP BY 1, 2)
SELECT series_id, {steady_sql('avg(mse)')} AS mse, {steady_sql('avg(mae)')} AS mae, count(*) AS runs FROM runs GROUP BY 1""",
)
def repeat_mean(spark, sf_dir):
    """Each day counts as one run of a user's configuration."""
    runs = evaluation.metrics5(pairs(spark, sf_dir), [*KEY, "day"])
    rows = evaluation.repeat_mean(runs, KEY, ["mse", "mae"])
    return rows.select(*KEY, steady("mse").alias("mse"), steady("mae").alias("mae"), "runs")


@register(
    "pooled_loss",
    f"""WITH {PAIRS}, batches AS (
  SELECT series_id, day, sum(pow(value - yhat, 2)) AS loss_sum, count(*) AS n FROM pairs WHERE value <> 0 GROUP BY 1, 2)
SELECT series_id, {steady_sql('sum(loss_sum) / sum(n)')} AS loss FROM batches GROUP BY 1""",
)
def pooled_loss(spark, sf_dir):
    counted = pairs(spark, sf_dir).filter("value <> 0")
    error = evaluation.squared_error(F.col("value"), F.col("yhat"))
    batches = counted.groupBy(*KEY, "day").agg(F.sum(error).alias("loss_sum"), F.count("*").alias("n"))
    rows = evaluation.pooled_loss(batches, KEY)
    return rows.select(*KEY, steady("loss").alias("loss"))


@register(
    "forecast_overlay",
    f"""WITH {written(USER_HOURLY)}, both_sides AS (
  SELECT series_id, ts, value, NULL::DOUBLE AS yhat FROM user_hourly
  UNION ALL SELECT series_id, ts + INTERVAL 24 HOUR, NULL, value FROM user_hourly)
SELECT series_id, ts, max(value) AS value, max(yhat) AS yhat FROM both_sides GROUP BY 1, 2""",
)
def forecast_overlay(spark, sf_dir):
    rows = user_hourly(spark, sf_dir)
    forecast = rows.select(*KEY, shift(F.col("ts"), F.lit(24), HOUR).alias("ts"), F.col("value").alias("yhat"))
    both = evaluation.forecast_overlay(rows.select(*KEY, "ts", "value"), forecast, KEY)
    return both.select(*KEY, "ts", "value", "yhat")
