"""Queries for calendar features, row windows, resampling and panel shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions import calendar
from tideloom.operators import panel, rolling
from tideloom.operators.features import feature_matrix, feature_names
from tideloom.operators.ordering import row_position
from tideloom.plans.base import (
    CHANNELS,
    CHUNK,
    HOURLY,
    KEY,
    TICKS,
    USER_HOURLY,
    USER_HOURLY_GAPS,
    WIDE_GAPS,
    channels,
    events,
    hourly,
    hourly_sparse,
    rounded,
    sparse_sql,
    table,
    ticks,
    user_hourly,
    wide,
)
from tideloom.plans.registry import register
from tideloom.session import settle

# ---- 36-43 calendar and covariates ---------------------------------------------------------


@register(
    "calendar_raw",
    """SELECT event_id, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CAST(day(ts) AS DOUBLE) AS day_of_month,
  CAST(month(ts) AS DOUBLE) AS month, CAST(hour(ts) AS DOUBLE) AS hour FROM events""",
)
def calendar_raw(spark, sf_dir):
    columns = calendar.calendar_raw(F.col("ts"))
    return events(spark, sf_dir).select("event_id", *[c.cast("double").alias(n) for n, c in columns.items()])


# How each normalised feature reads in SQL.
NORM_SQL = {
    "second_of_minute": "CAST(floor(second(ts)) AS DOUBLE) / 59.0::DOUBLE - 0.5::DOUBLE",
    "minute_of_hour": "CAST(minute(ts) AS DOUBLE) / 59.0::DOUBLE - 0.5::DOUBLE",
    "hour_of_day": "CAST(hour(ts) AS DOUBLE) / 23.0::DOUBLE - 0.5::DOUBLE",
    "day_of_week": "CAST(isodow(ts) - 1 AS DOUBLE) / 6.0::DOUBLE - 0.5::DOUBLE",
    "day_of_month": "CAST(day(ts) - 1 AS DOUBLE) / 30.0::DOUBLE - 0.5::DOUBLE",
    "day_of_year": "CAST(dayofyear(ts) - 1 AS DOUBLE) / 365.0::DOUBLE - 0.5::DOUBLE",
    "month_of_year": "CAST(month(ts) - 1 AS DOUBLE) / 11.0::DOUBLE - 0.5::DOUBLE",
    "week_of_year": "CAST(week(ts) - 1 AS DOUBLE) / 52.0::DOUBLE - 0.5::DOUBLE",
}


def norm_sql(names, id_column: str, ts: str, source: str) -> str:
    picks = ", ".join(f"round({NORM_SQL[n]}, 9) AS {n}" for n in names)
    return f"SELECT id, {picks} FROM (SELECT {id_column} AS id, {ts} AS ts FROM {source})"


def norm_columns(columns):
    return [rounded(c, 9).alias(n) for n, c in columns.items()]


@register("calendar_norm", norm_sql(NORM_SQL, "event_id", "ts", "events"))
def calendar_norm(spark, sf_dir):
    columns = calendar.calendar_norm(F.col("ts"))
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), *norm_columns(columns))


@register(
    "calendar_by_freq",
    f"""SELECT * FROM (SELECT 'hourly' AS freq, id, hour_of_day, day_of_week, day_of_month, day_of_year, NULL::DOUBLE AS week_of_year
  FROM ({norm_sql(['hour_of_day', 'day_of_week', 'day_of_month', 'day_of_year'], 'event_id', 'ts', 'events')}))
UNION ALL SELECT 'weekly', id, NULL, NULL, day_of_month, NULL, week_of_year
  FROM ({norm_sql(['day_of_month', 'week_of_year'], 'o_orderkey', 'o_orderdate', 'orders')})""",
)
def calendar_by_freq(spark, sf_dir):
    hours = events(spark, sf_dir).select(
        F.lit("hourly").alias("freq"), F.col("event_id").alias("id"), *norm_columns(calendar.calendar_by_freq(F.col("ts"), "12H"))
    )
    weeks = table(spark, sf_dir, "orders").select(
        F.lit("weekly").alias("freq"),
        F.col("o_orderkey").alias("id"),
        *norm_columns(calendar.calendar_by_freq(F.col("o_orderdate"), "W-SUN")),
    )
    return hours.unionByName(weeks, allowMissingColumns=True)


@register(
    "calendar_int",
    """SELECT event_id, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(isodow(ts) - 1 AS INT) AS weekday,
  CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) // 15 AS INT) AS minute FROM events""",
)
def calendar_int(spark, sf_dir):
    columns = calendar.calendar_int(F.col("ts"), "t")
    return events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in columns.items()])


@register(
    "calendar_fraction",
    """SELECT event_id, round((isodow(ts) - 1) / 7.0::DOUBLE, 9) AS weekday, round(hour(ts) / 24.0::DOUBLE, 9) AS hour,
  round(month(ts) / 12.0::DOUBLE, 9) AS month FROM events""",
)
def calendar_fraction(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", *norm_columns(calendar.calendar_fraction(F.col("ts"))))


@register(
    "calendar_cyclic",
    "SELECT o_orderkey, "
    + ", ".join(
        f"round({f}(2.0::DOUBLE * pi() * ({part})), 6) AS {name}_{f}"
        for name, part in {
            "year": "year(o_orderdate) / 365.0::DOUBLE",
            "month": "month(o_orderdate) / 12.0::DOUBLE",
            "day": "day(o_orderdate) / 31.0::DOUBLE",
            "weekday": "(isodow(o_orderdate) - 1) / 7.0::DOUBLE",
        }.items()
        for f in ("cos", "sin")
    )
    + " FROM orders",
)
def calendar_cyclic(spark, sf_dir):
    columns = calendar.calendar_cyclic(F.col("o_orderdate"))
    zeroed = [(rounded(c) + F.lit(0.0)).alias(n) for n, c in columns.items()]
    return table(spark, sf_dir, "orders").select("o_orderkey", *zeroed)


@register(
    "position_sinusoid",
    f"""WITH {TICKS}, dims AS (SELECT unnest(generate_series(0, 7)) AS i)
SELECT event_id, i, round(CASE WHEN i % 2 = 0 THEN sin(pos / pow(10000.0::DOUBLE, (i // 2) * 2.0::DOUBLE / 8.0::DOUBLE))
  ELSE cos(pos / pow(10000.0::DOUBLE, (i // 2) * 2.0::DOUBLE / 8.0::DOUBLE)) END, 6) AS value
FROM ticks CROSS JOIN dims""",
)
def position_sinusoid(spark, sf_dir):
    rows = row_position(ticks(spark, sf_dir), KEY, ["ts", "event_id"])
    waves = calendar.position_sinusoid(F.col("pos").cast("double"), 8)
    rows = rows.select("event_id", F.posexplode(waves).alias("i", "value"))
    return rows.select("event_id", "i", (rounded("value") + F.lit(0.0)).alias("value"))


@register(
    "series_covariates",
    f"""WITH ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS series_index,
  count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT e.event_id, series_index, round(series_index / n::DOUBLE - 0.5::DOUBLE, 9) AS series_unit,
  round((isodow(ts) - 1) / 7.0::DOUBLE, 9) AS weekday, round(hour(ts) / 24.0::DOUBLE, 9) AS hour, round(month(ts) / 12.0::DOUBLE, 9) AS month
FROM events e JOIN ids USING (user_id)""",
)
def series_covariates(spark, sf_dir):
    rows = panel.series_covariates(events(spark, sf_dir), ["user_id"])
    marks = norm_columns(calendar.calendar_fraction(F.col("ts")))
    return rows.select("event_id", "series_index", rounded("series_unit", 9).alias("series_unit"), *marks)


# ---- 44-49 row windows ---------------------------------------------------------------------


@register(
    "lag1",
    f"""WITH {USER_HOURLY}
SELECT series_id, pos, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS value_lag1 FROM user_hourly""",
)
def lag1(spark, sf_dir):
    rows = rolling.lag1(user_hourly(spark, sf_dir), ["value"], KEY, chunk=CHUNK)
    return rows.select("series_id", "pos", "value_lag1")


def rolling_sql(aggregate: str, name: str) -> str:
    return f"""WITH {USER_HOURLY_GAPS}
SELECT series_id, pos, CASE WHEN count(value) OVER w = 5 THEN round({aggregate}(value) OVER w, 6) END AS {name}
FROM user_hourly WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


@register("rolling_mean", rolling_sql("avg", "value_rolling_mean"))
def rolling_mean(spark, sf_dir):
    rows = rolling.rolling_mean(user_hourly(spark, sf_dir, fill=None), ["value"], KEY, chunk=CHUNK)
    return rows.select("series_id", "pos", rounded("value_rolling_mean").alias("value_rolling_mean"))


@register("rolling_std", rolling_sql("stddev_samp", "value_rolling_std"))
def rolling_std(spark, sf_dir):
    rows = rolling.rolling_std(user_hourly(spark, sf_dir, fill=None), ["value"], KEY, chunk=CHUNK)
    return rows.select("series_id", "pos", rounded("value_rolling_std").alias("value_rolling_std"))


@register(
    "ffill",
    f"""WITH {USER_HOURLY_GAPS}
SELECT series_id, pos, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM user_hourly""",
)
def ffill(spark, sf_dir):
    rows = rolling.ffill(user_hourly(spark, sf_dir, fill=None), ["value"], KEY, chunk=CHUNK)
    return rows.select("series_id", "pos", "value")


@register(
    "bfill",
    f"""WITH {USER_HOURLY_GAPS}
SELECT series_id, pos, first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM user_hourly""",
)
def bfill(spark, sf_dir):
    rows = rolling.bfill(user_hourly(spark, sf_dir, fill=None), ["value"], KEY, chunk=CHUNK)
    return rows.select("series_id", "pos", "value")


def feature_matrix_sql() -> str:
    base = [*CHANNELS, "day_of_week", "day_of_month", "month", "hour"]
    bounds = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in CHANNELS)
    inside = " AND ".join(
        f"COALESCE({c} BETWEEN {c}_q1 - ({c}_q3 - {c}_q1) * 1.5::DOUBLE AND {c}_q3 + ({c}_q3 - {c}_q1) * 1.5::DOUBLE, TRUE)"
        for c in CHANNELS
    )
    kept = ", ".join(CHANNELS)
    forward = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in CHANNELS
    )
    backward = ", ".join(
        f"first_value({c} IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}" for c in CHANNELS
    )
    fits = ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_w" for c in base
    )
    scaled = ", ".join(f"({c} - {c}_m) / CASE WHEN {c}_w = 0 THEN 1 ELSE {c}_w END AS {c}" for c in base)
    derived = ", ".join(
        f"lag({c}) OVER (ORDER BY pos) AS {c}_lag1, "
        f"CASE WHEN count({c}) OVER w = 5 THEN avg({c}) OVER w END AS {c}_rolling_mean, "
        f"CASE WHEN count({c}) OVER w = 5 THEN stddev_samp({c}) OVER w END AS {c}_rolling_std"
        for c in base
    )
    names = [f"{c}_{k}" for c in base for k in ("lag1", "rolling_mean", "rolling_std")]
    filled = ", ".join(f"round(COALESCE({n}, first_value({n} IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS {n}" for n in names)
    plain = ", ".join(f"round({c}, 6) AS {c}" for c in base)
    return f"""WITH {WIDE_GAPS},
bounds AS (SELECT {bounds} FROM wide),
kept AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, {kept} FROM wide CROSS JOIN bounds WHERE {inside}),
forward AS (SELECT ts, pos, {forward} FROM kept),
filled AS (SELECT ts, pos, {backward}, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CAST(day(ts) AS DOUBLE) AS day_of_month,
  CAST(month(ts) AS DOUBLE) AS month, CAST(hour(ts) AS DOUBLE) AS hour FROM forward),
size AS (SELECT count(*) AS n FROM filled),
fits AS (SELECT {fits} FROM filled CROSS JOIN size WHERE pos < floor(n::DOUBLE * 0.7::DOUBLE)),
scaled AS (SELECT ts, pos, {scaled} FROM filled CROSS JOIN fits),
derived AS (SELECT *, {derived} FROM scaled WINDOW w AS (ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT ts, pos, {plain}, {filled},
  CASE WHEN pos < floor(n::DOUBLE * 0.7::DOUBLE) THEN 'train'
       WHEN pos < floor(n::DOUBLE * 0.7::DOUBLE) + floor(n::DOUBLE * 0.2::DOUBLE) THEN 'valid' ELSE 'test' END AS split
FROM derived CROSS JOIN size"""


@register("feature_matrix", feature_matrix_sql())
def feature_matrix_query(spark, sf_dir):
    # The filter, the quartiles and the fill all read the table, so it is built once.
    table = settle(wide(spark, sf_dir, fill=None))
    names = table.columns[2:]
    rows = feature_matrix(table, names, chunk=CHUNK)
    return rows.select("ts", "pos", *[rounded(c).alias(c) for c in feature_names(names)], "split")


# ---- 50-58 resampling and panels -----------------------------------------------------------


@register("resample_sum", f"WITH {HOURLY} SELECT series_id, ts, value FROM hourly")
def resample_sum(spark, sf_dir):
    return hourly(spark, sf_dir).select("series_id", "ts", "value")


@register("dense_grid", f"WITH {USER_HOURLY} SELECT series_id, ts, pos, value FROM user_hourly")
def dense_grid(spark, sf_dir):
    return user_hourly(spark, sf_dir).select("series_id", "ts", "pos", "value")


FIRST_ACTIVE = """firsts AS (
  SELECT series_id, COALESCE(min(pos) FILTER (WHERE value <> 0), 0) AS first_pos FROM user_hourly GROUP BY 1)"""


@register("first_active", f"WITH {USER_HOURLY}, {FIRST_ACTIVE} SELECT series_id, first_pos FROM firsts")
def first_active(spark, sf_dir):
    return panel.first_active(user_hourly(spark, sf_dir), KEY)


@register(
    "late_series_filter",
    f"""WITH {USER_HOURLY}, {FIRST_ACTIVE}
SELECT series_id, pos, value FROM user_hourly WHERE series_id IN (SELECT series_id FROM firsts WHERE first_pos < 12)""",
)
def late_series_filter(spark, sf_dir):
    return panel.late_series_filter(user_hourly(spark, sf_dir), KEY, limit=12).select("series_id", "pos", "value")


@register(
    "common_start_trim",
    f"""WITH {USER_HOURLY}, {FIRST_ACTIVE}, latest AS (SELECT max(first_pos) AS f FROM firsts)
SELECT series_id, pos - f AS pos, value FROM user_hourly CROSS JOIN latest WHERE pos >= f""",
)
def common_start_trim(spark, sf_dir):
    return panel.common_start_trim(user_hourly(spark, sf_dir), KEY).select("series_id", "pos", "value")


GROUPED = """grouped AS (
  SELECT event_type, user_id, event_id, ts, value,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


@register(
    "panel_group",
    f"""WITH {GROUPED}
SELECT event_type, user_id, event_id, pos, value, round((isodow(ts) - 1) / 7.0::DOUBLE, 9) AS weekday,
  round(hour(ts) / 24.0::DOUBLE, 9) AS hour, round(month(ts) / 12.0::DOUBLE, 9) AS month FROM grouped""",
)
def panel_group(spark, sf_dir):
    rows = panel.panel_group(events(spark, sf_dir), ["event_type", "user_id"], ["ts", "event_id"])
    marks = [rounded(c, 9).alias(c) for c in ("weekday", "hour", "month")]
    return rows.select("event_type", "user_id", "event_id", "pos", "value", *marks)


@register(
    "panel_quality_filter",
    f"""WITH {USER_HOURLY}, good AS (SELECT series_id FROM user_hourly GROUP BY 1
  HAVING avg(CASE WHEN value = 0 THEN 1 ELSE 0 END) <= 0.91 AND count(*) >= 700)
SELECT series_id, pos, value FROM user_hourly WHERE series_id IN (SELECT series_id FROM good)""",
)
def panel_quality_filter(spark, sf_dir):
    rows = panel.panel_quality_filter(user_hourly(spark, sf_dir), KEY, max_zero_share=0.91, min_length=700)
    return rows.select("series_id", "pos", "value")


@register(
    "tail_align",
    f"""WITH {GROUPED}, sizes AS (SELECT event_type, user_id, count(*) AS n FROM grouped GROUP BY 1, 2),
shortest AS (SELECT min(n) AS keep FROM sizes)
SELECT event_type, user_id, event_id, pos - n + keep AS pos FROM grouped JOIN sizes USING (event_type, user_id)
CROSS JOIN shortest WHERE pos >= n - keep""",
)
def tail_align(spark, sf_dir):
    rows = row_position(events(spark, sf_dir), ["event_type", "user_id"], ["ts", "event_id"])
    rows = panel.tail_align(rows, ["event_type", "user_id"])
    return rows.select("event_type", "user_id", "event_id", "pos")


@register(
    "panel_pivot",
    f"""WITH {sparse_sql('hourly', 'event_type')}
SELECT s.ts, k.series_id, v.value FROM (SELECT DISTINCT ts FROM hourly_sparse) s
CROSS JOIN (SELECT DISTINCT series_id FROM hourly_sparse) k
LEFT JOIN hourly_sparse v ON v.ts = s.ts AND v.series_id = k.series_id""",
)
def panel_pivot(spark, sf_dir):
    names = channels(spark, sf_dir)
    rows = panel.as_channels(hourly_sparse(spark, sf_dir), names)
    # Series that share a column are added first; there is one value for every tick and column.
    rows = rows.groupBy("ts", "series_id").agg(F.sum("value").alias("value"))
    matrix = panel.panel_pivot(rows, names)
    return panel.panel_unpivot(matrix, names).select("ts", "series_id", "value")
