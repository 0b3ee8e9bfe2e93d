"""Queries for sources, filters, positions, splits and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions.times import HOUR, shift
from tideloom.models.arima import ar1_fit
from tideloom.operators import filters, scaling, splits
from tideloom.operators.ordering import row_position, tail_n, with_length
from tideloom.operators.panel import as_channels
from tideloom.operators.windows import (
    strided_panel_windows,
    window_mean_scale,
    window_mean_unscale,
    window_norm_params,
    window_standardise,
)
from tideloom.plans.base import (
    CHANNELS,
    CHUNK,
    KEY,
    TICKS,
    USER_HOURLY,
    WIDE,
    WIDE_GAPS,
    channels,
    events,
    hourly_sparse,
    rounded,
    sparse_sql,
    table,
    ticks,
    user_hourly,
    wide,
)
from tideloom.plans.registry import register
from tideloom.session import fresh_path
from tideloom.sources import files, store

USER_CHANNELS_SQL = ", ".join(
    f"CAST(SUM(CAST(value AS DECIMAL(28,2))) FILTER (WHERE event_type = '{c}') AS DOUBLE) AS {c}" for c in CHANNELS
)


def user_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and hour with a column per event type, gaps left open."""
    names = channels(spark, sf_dir)
    rows = as_channels(events(spark, sf_dir), names, "event_type")
    amount = F.col("value").cast("decimal(28,2)")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return rows.groupBy(hour, "user_id").agg(
        *[F.sum(F.when(F.col("event_type") == c, amount)).cast("double").alias(c) for c in names]
    )


USER_TABLE = f"""user_table AS (
  SELECT date_trunc('hour', ts) AS ts, user_id, {USER_CHANNELS_SQL} FROM events GROUP BY 1, 2)"""


# ---- 1-9 sources and sinks ---------------------------------------------------------------


@register("csv_scan", f"WITH {USER_TABLE} SELECT ts, user_id, {', '.join(CHANNELS)} FROM user_table")
def csv_scan(spark, sf_dir):
    path = fresh_path(spark, "csv")
    rows = user_table(spark, sf_dir)
    rows.write.option("header", True).csv(path)
    schema = "ts TIMESTAMP_NTZ, user_id BIGINT, " + ", ".join(f"`{c}` DOUBLE" for c in rows.columns[2:])
    return files.csv_scan(spark, path, schema)


@register(
    "csv_multi_union",
    f"""WITH {USER_TABLE}
SELECT ts, user_id, click, error, CAST(NULL AS DOUBLE) AS view FROM user_table WHERE ts < TIMESTAMP '2024-01-15'
UNION ALL
SELECT ts, user_id, click, NULL, view FROM user_table WHERE ts >= TIMESTAMP '2024-01-15'""",
)
def csv_multi_union(spark, sf_dir):
    rows = user_table(spark, sf_dir)
    first, second = fresh_path(spark, "csv"), fresh_path(spark, "csv")
    border = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rows.filter(F.col("ts") < border).select("ts", "user_id", "click", "error").write.option("header", True).csv(first)
    # The second file also has every event type that the tables are not known to have.
    more = ["click", "view", *[c for c in rows.columns[2:] if c not in CHANNELS]]
    rows.filter(F.col("ts") >= border).select("ts", "user_id", *more).write.option("header", True).csv(second)
    return files.csv_multi_union(
        spark,
        {
            first: "ts TIMESTAMP_NTZ, user_id BIGINT, click DOUBLE, error DOUBLE",
            second: "ts TIMESTAMP_NTZ, user_id BIGINT, " + ", ".join(f"`{c}` DOUBLE" for c in more),
        },
    )


@register("csv_locale", f"WITH {WIDE_GAPS} SELECT ts, {', '.join(CHANNELS)} FROM wide")
def csv_locale(spark, sf_dir):
    path = fresh_path(spark, "csv")
    rows = wide(spark, sf_dir, fill=None).drop("pos")
    names = rows.columns[1:]
    text = [F.regexp_replace(F.col(c).cast("string"), r"\.", ",").alias(c) for c in names]
    rows.select("ts", *text).write.option("header", True).option("sep", ";").csv(path)
    return files.csv_locale(spark, path, "ts", names)


@register(
    "csv_headerless",
    "SELECT event_type AS app_name, CAST(user_id AS VARCHAR) AS zone, ts AS time, value FROM events",
)
def csv_headerless(spark, sf_dir):
    path = fresh_path(spark, "csv")
    rows = events(spark, sf_dir).select("event_type", "user_id", "ts", "value")
    rows.write.option("header", False).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return files.csv_headerless(spark, path)


@register(
    "panel_array_scan",
    """SELECT vec_id, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS value
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)""",
)
def panel_array_scan(spark, sf_dir):
    rows = files.panel_array_scan(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@register(
    "typed_ingest",
    """SELECT event_id,
  CASE WHEN event_id % 11 = 3 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_id % 7 = 2 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 7 = 2 AND event_id % 11 = 3 THEN 'ts,value'
       WHEN event_id % 11 = 3 THEN 'ts' WHEN event_id % 7 = 2 THEN 'value' END AS error
FROM events""",
)
def typed_ingest(spark, sf_dir):
    rows = events(spark, sf_dir)
    text = rows.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 3, "yesterday").otherwise(F.col("ts").cast("string")).alias("ts"),
        F.when(F.col("event_id") % 7 == 2, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )
    return files.typed_ingest(text, "ts", ["value"])


NAIVE_FORECAST = f"""WITH {USER_HOURLY},
ends AS (SELECT series_id, max(ts) AS last, max_by(value, pos) AS y FROM user_hourly GROUP BY 1),
steps AS (SELECT unnest(generate_series(1, 6)) AS step)"""


def last_value_forecast(spark, sf_dir):
    """The last hour of every user carried six steps ahead, under two model names."""
    rows = user_hourly(spark, sf_dir)
    ends = rows.groupBy(*KEY).agg(F.max("ts").alias("last"), F.max_by("value", "pos").alias("y"))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(6))))
    out = steps.select("series_id", "step", shift(F.col("last"), F.col("step"), HOUR).alias("ts"), "y")
    models = F.explode(F.array(F.struct(F.lit("level").alias("model"), F.col("y").alias("yhat")),
                               F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("yhat"))))
    return out.withColumn("_m", models).select("series_id", "step", "ts", "_m.model", "_m.yhat")


@register(
    "forecast_sink",
    f"""{NAIVE_FORECAST}
SELECT series_id, step, last + step * INTERVAL 1 HOUR AS ts, model, CASE WHEN model = 'level' THEN y ELSE 0.0 END AS yhat
FROM ends CROSS JOIN steps CROSS JOIN (VALUES ('level'), ('zero')) m(model)""",
)
def forecast_sink(spark, sf_dir):
    path = fresh_path(spark, "forecasts")
    forecasts = last_value_forecast(spark, sf_dir)
    store.write_forecasts(forecasts, path)
    read = spark.read.schema(forecasts.schema).parquet(path)
    return read.select("series_id", "step", "ts", "model", "yhat")


AR1_SQL = """ar1 AS (
  SELECT series_id, regr_slope(value, before) AS phi, regr_intercept(value, before) AS intercept,
         count(before) AS n_pairs
  FROM (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS before FROM {0})
  GROUP BY series_id)"""


def stored_models(spark, sf_dir):
    """AR(1) models of the users with an even number, written to the model table."""
    path = fresh_path(spark, "models")
    models = ar1_fit(user_hourly(spark, sf_dir), KEY, chunk=CHUNK).filter(F.col("series_id") % 2 == 0)
    store.save_models(models.withColumn("model", F.lit("ar1")), path)
    return store.load_models(spark, path, "ar1")


@register(
    "model_store",
    f"""WITH {USER_HOURLY}, {AR1_SQL.format('user_hourly')}
SELECT u.series_id, sum(u.pos) AS rows_seen, 'ar1' AS model, round(any_value(phi), 6) AS phi,
       round(any_value(intercept), 6) AS intercept
FROM user_hourly u JOIN ar1 ON ar1.series_id = u.series_id WHERE u.series_id % 2 = 0 GROUP BY u.series_id""",
)
def model_store(spark, sf_dir):
    rows = user_hourly(spark, sf_dir).groupBy(*KEY).agg(F.sum("pos").alias("rows_seen"))
    loaded = rows.join(stored_models(spark, sf_dir), KEY)
    return loaded.select(*KEY, "rows_seen", "model", rounded("phi").alias("phi"), rounded("intercept").alias("intercept"))


@register("fit_missing", "SELECT DISTINCT user_id AS series_id, 'ar1' AS model FROM events WHERE user_id % 2 = 1")
def fit_missing(spark, sf_dir):
    wanted = events(spark, sf_dir).select(F.col("user_id").alias("series_id")).distinct()
    wanted = wanted.withColumn("model", F.lit("ar1"))
    return store.fit_missing(wanted, stored_models(spark, sf_dir), KEY)


# ---- 10-16 projections and filters -------------------------------------------------------


@register("parse_time", "SELECT event_id, CASE WHEN event_id % 9 = 4 THEN NULL ELSE ts END AS parsed FROM events")
def parse_time(spark, sf_dir):
    text = F.when(F.col("event_id") % 9 == 4, "13/13/2024").otherwise(F.col("ts").cast("string"))
    rows = events(spark, sf_dir).select("event_id", text.alias("text"))
    return filters.parse_time(rows, "text", "parsed").drop("text")


@register("time_sort", "SELECT event_type AS series_id, ts, event_id, value FROM events ORDER BY 1, 2, 3")
def time_sort(spark, sf_dir):
    return filters.time_sort(ticks(spark, sf_dir), KEY, ["ts", "event_id"])


@register("column_roles", f"WITH {WIDE} SELECT ts, click, error, view FROM wide")
def column_roles(spark, sf_dir):
    rows = wide(spark, sf_dir)
    more = [c for c in rows.columns[2:] if c not in CHANNELS]
    return filters.column_roles(rows, "ts", target="click", features=["error", "view", *more])


@register("require_columns", f"WITH {USER_TABLE} SELECT ts, user_id, click, view FROM user_table")
def require_columns(spark, sf_dir):
    rows = user_table(spark, sf_dir)
    needed = ["ts", "user_id", "click", "view", *[c for c in rows.columns[2:] if c not in CHANNELS]]
    checked = filters.require_columns(rows, needed, context_length=24, prediction_length=6)
    return checked.select(*needed)


@register(
    "numeric_cast",
    f"WITH {USER_TABLE} SELECT ts, user_id, "
    + ", ".join(f"CAST(CAST(COALESCE({c}, 0) AS FLOAT) AS DOUBLE) AS {c}" for c in CHANNELS)
    + " FROM user_table",
)
def numeric_cast(spark, sf_dir):
    rows = user_table(spark, sf_dir)
    names = rows.columns[2:]
    rows = filters.numeric_cast(rows, ["user_id", *names])
    return rows.select("ts", "user_id", *[F.col(c).cast("double").alias(c) for c in names])


def quartile_sql(cols, source: str) -> str:
    picks = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in cols)
    return f"bounds AS (SELECT {picks} FROM {source})"


def inside_sql(cols) -> str:
    return " AND ".join(
        f"COALESCE({c} BETWEEN {c}_q1 - ({c}_q3 - {c}_q1) * 1.5::DOUBLE AND {c}_q3 + ({c}_q3 - {c}_q1) * 1.5::DOUBLE, TRUE)"
        for c in cols
    )


@register(
    "iqr_filter",
    f"""WITH {USER_TABLE}, {quartile_sql(CHANNELS, 'user_table')}
SELECT ts, user_id, {', '.join(CHANNELS)} FROM user_table CROSS JOIN bounds WHERE {inside_sql(CHANNELS)}""",
)
def iqr_filter(spark, sf_dir):
    rows = user_table(spark, sf_dir)
    return filters.iqr_filter(rows, rows.columns[2:])


@register(
    "date_slice",
    """SELECT event_id, event_type AS series_id, ts, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-19 23:00:00'""",
)
def date_slice(spark, sf_dir):
    rows = filters.date_slice(ticks(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-19 23:00:00")
    return rows.select("event_id", "series_id", "ts", "value")


# ---- 17-26 positions and splits ----------------------------------------------------------


@register("row_position", f"WITH {TICKS} SELECT series_id, event_id, pos FROM ticks")
def row_position_query(spark, sf_dir):
    return row_position(ticks(spark, sf_dir), KEY, ["ts", "event_id"]).select("series_id", "event_id", "pos")


TICK_COUNT = f"{TICKS}, counts AS (SELECT series_id, count(*) AS n FROM ticks GROUP BY 1)"


def numbered_ticks(spark, sf_dir):
    return row_position(ticks(spark, sf_dir), KEY, ["ts", "event_id"])


@register(
    "split_train_test",
    f"""WITH {TICK_COUNT}
SELECT series_id, event_id, pos, CASE WHEN pos < floor(n::DOUBLE * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM ticks JOIN counts USING (series_id)""",
)
def split_train_test(spark, sf_dir):
    rows = splits.split_train_test(numbered_ticks(spark, sf_dir), KEY)
    return rows.select("series_id", "event_id", "pos", "split")


@register(
    "split_three_way",
    f"""WITH {TICK_COUNT}
SELECT series_id, event_id, pos,
  CASE WHEN pos < floor(n::DOUBLE * 0.7::DOUBLE) THEN 'train'
       WHEN pos < floor(n::DOUBLE * 0.7::DOUBLE) + floor(n::DOUBLE * 0.2::DOUBLE) THEN 'valid' ELSE 'test' END AS split
FROM ticks JOIN counts USING (series_id)""",
)
def split_three_way(spark, sf_dir):
    rows = splits.split_three_way(numbered_ticks(spark, sf_dir), KEY)
    return rows.select("series_id", "event_id", "pos", "split")


@register(
    "split_overlap",
    f"""WITH {TICK_COUNT},
spans AS (
  SELECT series_id, 'train' AS split, 0 AS low, floor(n::DOUBLE * 0.7::DOUBLE) AS high FROM counts
  UNION ALL SELECT series_id, 'valid', floor(n::DOUBLE * 0.7::DOUBLE) - 24, n - floor(n::DOUBLE * 0.2::DOUBLE) FROM counts
  UNION ALL SELECT series_id, 'test', n - floor(n::DOUBLE * 0.2::DOUBLE) - 24, n FROM counts)
SELECT t.series_id, t.event_id, t.pos, s.split
FROM ticks t JOIN spans s ON s.series_id = t.series_id AND t.pos >= s.low AND t.pos < s.high""",
)
def split_overlap(spark, sf_dir):
    rows = splits.split_overlap(numbered_ticks(spark, sf_dir), KEY, context=24)
    return rows.select("series_id", "event_id", "pos", "split")


def calendar_split_sql(month: int, seq_len: int) -> str:
    return f"""WITH {USER_HOURLY}, spans(split, low, high) AS (VALUES
  ('train', 0, {12 * month}), ('valid', {12 * month - seq_len}, {16 * month}), ('test', {16 * month - seq_len}, {20 * month}))
SELECT series_id, pos, split FROM user_hourly JOIN spans ON pos >= low AND pos < high"""


# A "month" of one day (hourly) or six hours (quarter-hour ticks) lets 30 days hold all splits.
@register("split_calendar_hour", calendar_split_sql(24, 48))
def split_calendar_hour(spark, sf_dir):
    rows = splits.split_calendar(user_hourly(spark, sf_dir), seq_len=48, month_days=1)
    return rows.select("series_id", "pos", "split")


@register(
    "split_calendar_minute",
    f"""WITH ticks15 AS (SELECT DISTINCT event_type AS series_id, date_diff('minute', TIMESTAMP '2024-01-01', ts) // 15 AS pos FROM events),
spans(split, low, high) AS (VALUES ('train', 0, {12 * 96}), ('valid', {12 * 96 - 96}, {16 * 96}), ('test', {16 * 96 - 96}, {20 * 96}))
SELECT series_id, pos, split FROM ticks15 JOIN spans ON pos >= low AND pos < high""",
)
def split_calendar_minute(spark, sf_dir):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    quarter = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)) / F.lit(900_000_000))
    rows = ticks(spark, sf_dir).select("series_id", quarter.alias("pos")).distinct()
    return splits.split_calendar(rows, seq_len=96, ticks_per_hour=4, month_days=1).select("series_id", "pos", "split")


@register(
    "split_by_date",
    f"""WITH {USER_HOURLY},
borders AS (SELECT series_id, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-24 23:00:00') AS train_end FROM user_hourly GROUP BY 1)
SELECT series_id, pos, split FROM user_hourly JOIN borders USING (series_id)
JOIN (VALUES ('train'), ('test')) k(split) ON CASE split WHEN 'train' THEN pos < train_end ELSE pos >= train_end - 48 + 1 END""",
)
def split_by_date(spark, sf_dir):
    rows = splits.split_by_date(user_hourly(spark, sf_dir), "2024-01-24 23:00:00", 48, KEY)
    return rows.select("series_id", "pos", "split")


def panel_split_sql(border: str) -> str:
    return f"""WITH {TICK_COUNT}, borders AS (SELECT series_id, n, {border} AS train_end FROM counts)
SELECT series_id, event_id, pos, train_end, split FROM ticks JOIN borders USING (series_id)
JOIN (VALUES ('train'), ('test')) k(split) ON CASE split WHEN 'train' THEN pos < train_end ELSE pos >= train_end - 48 + 1 END"""


@register(
    "split_panel_tail",
    panel_split_sql("CAST(least(floor(n::DOUBLE * 0.8::DOUBLE), n - 1000) AS BIGINT)"),
)
def split_panel_tail(spark, sf_dir):
    border = splits.panel_tail_border(F.col("n_rows"))
    rows = splits.split_panel(numbered_ticks(spark, sf_dir), KEY, border, seq_len=48)
    return rows.select("series_id", "event_id", "pos", "train_end", "split")


@register(
    "split_by_window_count",
    panel_split_sql("CAST(48 + 24 + floor(0.9::DOUBLE * ((n - 48 - 24)::DOUBLE / 24.0::DOUBLE)) * 24 AS BIGINT)"),
)
def split_by_window_count(spark, sf_dir):
    border = splits.window_count_border(F.col("n_rows"), 48, 24)
    rows = splits.split_panel(numbered_ticks(spark, sf_dir), KEY, border, seq_len=48)
    return rows.select("series_id", "event_id", "pos", "train_end", "split")


@register(
    "tail_n",
    """SELECT user_id, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10""",
)
def tail_n_query(spark, sf_dir):
    rows = tail_n(events(spark, sf_dir), 10, ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_id", "ts", "value")


# ---- 27-35 scaling -----------------------------------------------------------------------

USER_TRAIN = f"""{USER_HOURLY}, counts AS (SELECT series_id, count(*) AS n FROM user_hourly GROUP BY 1),
train AS (SELECT u.* FROM user_hourly u JOIN counts USING (series_id) WHERE pos < floor(n::DOUBLE * 0.7::DOUBLE))"""


def user_train(spark, sf_dir):
    rows = user_hourly(spark, sf_dir)
    train = with_length(rows, KEY).filter(F.col("pos") < splits.fraction(F.col("n_rows"), 0.7))
    return rows, train.drop("n_rows")


def scaled_sql(center: str, width: str, formula: str = "(u.value - center) / width") -> str:
    return f"""WITH {USER_TRAIN},
params AS (SELECT series_id, {center} AS center, {width} AS raw FROM train GROUP BY 1),
fitted AS (SELECT series_id, center, CASE WHEN raw = 0 THEN 1 ELSE raw END AS width FROM params)
SELECT u.series_id, u.pos, round({formula}, 6) AS value FROM user_hourly u JOIN fitted USING (series_id)"""


def scaled(spark, sf_dir, fit):
    rows, train = user_train(spark, sf_dir)
    out = scaling.scale(rows, fit(train, ["value"], KEY), ["value"], KEY)
    return out.select("series_id", "pos", rounded("value").alias("value"))


@register("scale_minmax", scaled_sql("min(value)", "max(value) - min(value)"))
def scale_minmax(spark, sf_dir):
    return scaled(spark, sf_dir, scaling.fit_minmax)


# User series are mostly zero, so quartiles are taken over the hours with events.
@register(
    "scale_robust",
    f"""WITH {sparse_sql('user', 'user_id')},
params AS (SELECT series_id, quantile_cont(value, 0.5) AS center, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS raw
           FROM user_sparse GROUP BY 1)
SELECT u.series_id, u.ts, round((u.value - center) / CASE WHEN raw = 0 THEN 1 ELSE raw END, 6) AS value
FROM user_sparse u JOIN params USING (series_id)""",
)
def scale_robust(spark, sf_dir):
    rows = hourly_sparse(spark, sf_dir, "user_id")
    out = scaling.scale(rows, scaling.fit_robust(rows, ["value"], KEY), ["value"], KEY)
    return out.select("series_id", "ts", rounded("value").alias("value"))


@register("scale_standard", scaled_sql("avg(value)", "stddev_pop(value)"))
def scale_standard(spark, sf_dir):
    return scaled(spark, sf_dir, scaling.fit_standard)


@register(
    "unscale_standard",
    scaled_sql("avg(value)", "stddev_pop(value)", "0.5::DOUBLE * width + center"),
)
def unscale_standard(spark, sf_dir):
    rows, train = user_train(spark, sf_dir)
    params = scaling.fit_standard(train, ["value"], KEY)
    forecast = rows.withColumn("value", F.lit(0.5))
    out = scaling.unscale(forecast, params, ["value"], KEY)
    return out.select("series_id", "pos", rounded("value").alias("value"))


# Windows of 48 + 24 hours at stride 24 over every user.
STRIDED = f"""{USER_HOURLY}, lengths AS (SELECT series_id, count(*) AS n FROM user_hourly GROUP BY 1),
starts AS (SELECT series_id, unnest(generate_series(0, CAST(floor((n - 48 - 24) / 24) - 1 AS BIGINT))) AS window_id FROM lengths),
cells AS (
  SELECT s.series_id, s.window_id, u.pos - s.window_id * 24 AS slot, u.value
  FROM starts s JOIN user_hourly u ON u.series_id = s.series_id AND u.pos >= s.window_id * 24 AND u.pos < s.window_id * 24 + 72),
stats AS (
  SELECT series_id, window_id, avg(value) FILTER (WHERE slot < 48) AS m,
         stddev_samp(value) FILTER (WHERE slot < 48) AS sd, stddev_pop(value) FILTER (WHERE slot < 48) AS sdp
  FROM cells GROUP BY 1, 2)"""


def strided(spark, sf_dir):
    rows = with_length(user_hourly(spark, sf_dir), KEY)
    return strided_panel_windows(rows, KEY, 48, 24, end="n_rows", chunk=CHUNK)


def cells(windows: DataFrame, *carry: str) -> DataFrame:
    """Window values as rows ``slot, value``; ``slot`` runs through the context and the horizon."""
    both = F.posexplode(F.concat("past", "future")).alias("slot", "value")
    return windows.select("series_id", "window_id", *carry, both)


@register(
    "window_mean_scale",
    f"""WITH {STRIDED}
SELECT series_id, window_id, slot, round(value / CASE WHEN m > 0 THEN m + 1 ELSE 1 END, 6) AS value
FROM cells JOIN stats USING (series_id, window_id)""",
)
def window_mean_scale_query(spark, sf_dir):
    rows = cells(window_mean_scale(strided(spark, sf_dir)))
    return rows.select("series_id", "window_id", "slot", rounded("value").alias("value"))


@register("window_mean_unscale", f"WITH {STRIDED} SELECT series_id, window_id, slot, round(value, 6) AS value FROM cells")
def window_mean_unscale_query(spark, sf_dir):
    windows = window_mean_unscale(window_mean_scale(strided(spark, sf_dir)), ["past", "future"])
    return cells(windows).select("series_id", "window_id", "slot", rounded("value").alias("value"))


@register(
    "window_norm_params",
    f"""WITH {STRIDED}
SELECT series_id, window_id, kind, round(CASE WHEN kind = 'mean' THEN m + 1 ELSE sd END, 6) AS v
FROM stats CROSS JOIN (VALUES ('mean'), ('std')) k(kind)""",
)
def window_norm_params_query(spark, sf_dir):
    windows = strided(spark, sf_dir)
    out = None
    for kind in ("mean", "std"):
        part = window_norm_params(windows, kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select("series_id", "window_id", "kind", rounded("v").alias("v"))


@register(
    "window_standardise",
    f"""WITH {STRIDED}
SELECT series_id, window_id, slot, round((value - m) / greatest(sdp, 1e-5), 6) AS value
FROM cells JOIN stats USING (series_id, window_id)""",
)
def window_standardise_query(spark, sf_dir):
    rows = cells(window_standardise(strided(spark, sf_dir)))
    return rows.select("series_id", "window_id", "slot", rounded("value").alias("value"))


@register(
    "amplitude_scale",
    f"""WITH {USER_HOURLY}, amplitudes AS (SELECT series_id, avg(value) - 2.5 AS v FROM user_hourly GROUP BY 1)
SELECT series_id, pos, round(CASE WHEN v > 0 THEN value / v ELSE value END, 6) AS value,
       round(CASE WHEN v > 0 THEN value ELSE value * v END, 6) AS restored
FROM user_hourly JOIN amplitudes USING (series_id)""",
)
def amplitude_scale(spark, sf_dir):
    rows = user_hourly(spark, sf_dir)
    amplitudes = rows.groupBy(*KEY).agg((F.avg("value") - 2.5).alias("v"))
    out = scaling.amplitude_scale(rows, amplitudes, KEY)
    out = scaling.amplitude_unscale(out.withColumn("restored", F.col("value")), ["restored"])
    return out.select("series_id", "pos", rounded("value").alias("value"), rounded("restored").alias("restored"))
