"""The series that the registered queries work on, in Spark and in SQL.

``ticks``        events as five irregular series, one per event type
``hourly``       hourly sums per event type on a full grid (five series)
``user_hourly``  hourly sums per user on a full grid (as many series as users)
``wide``         ``hourly`` with one column per event type
``daily``        order totals per priority and day on a full grid
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions.times import DAY, HOUR
from tideloom.operators.panel import as_channels, channel_names, dense_grid, resample_sum

# The event types of the test tables, which the SQL twins name. Queries take them from the data.
CHANNELS = ["click", "error", "purchase", "signup", "view"]
KEY = ["series_id"]
# Small chunks, so that series of the test tables span several.
CHUNK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def steady(c: Column | str, digits: int = 6) -> Column:
    """Round after a nudge, so that an exact tie falls the same way in both engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), digits)


def steady_sql(expression: str) -> str:
    return f"round({expression} + 1e-9::DOUBLE, 6)"


def channels(spark: SparkSession, sf_dir: str) -> list[str]:
    """The event types of the data, a bounded number of them by name."""
    return channel_names(events(spark, sf_dir), "event_type")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")


def hourly_sparse(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    rows = events(spark, sf_dir).select(F.col(key).alias("series_id"), "ts", "value")
    return resample_sum(rows, KEY, HOUR, decimals=2)


def hourly(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    return dense_grid(hourly_sparse(spark, sf_dir), KEY, HOUR, fill=fill)


def user_hourly(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    return dense_grid(hourly_sparse(spark, sf_dir, "user_id"), KEY, HOUR, fill=fill)


def wide(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """One row per hour with a column per event type found; ``pos`` is the hour's number."""
    names = channels(spark, sf_dir)
    rows = as_channels(hourly(spark, sf_dir, fill), names)
    return rows.groupBy("ts", "pos").pivot("series_id", names).agg(F.sum("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")
    )
    days = resample_sum(rows, KEY, DAY, closed="left", decimals=2)
    return dense_grid(days, KEY, DAY)


def sparse_sql(name: str, key: str) -> str:
    return f"""{name}_sparse AS (
  SELECT {key} AS series_id, date_trunc('hour', ts - INTERVAL 1 MICROSECOND) AS ts,
         CAST(SUM(CAST(value AS DECIMAL(28,2))) AS DOUBLE) AS value
  FROM events GROUP BY 1, 2)"""


def grid_sql(name: str, key: str, fill: str = "0") -> str:
    return f"""{sparse_sql(name, key)},
{name}_ticks AS (
  SELECT unnest(generate_series((SELECT min(ts) FROM {name}_sparse),
                                (SELECT max(ts) FROM {name}_sparse), INTERVAL 1 HOUR)) AS ts),
{name} AS (
  SELECT s.series_id, t.ts,
         row_number() OVER (PARTITION BY s.series_id ORDER BY t.ts) - 1 AS pos,
         {"v.value" if fill == "NULL" else f"COALESCE(v.value, {fill})"} AS value
  FROM (SELECT DISTINCT series_id FROM {name}_sparse) s
  CROSS JOIN {name}_ticks t
  LEFT JOIN {name}_sparse v ON v.series_id = s.series_id AND v.ts = t.ts)"""


HOURLY = grid_sql("hourly", "event_type")
HOURLY_GAPS = grid_sql("hourly", "event_type", "NULL")
USER_HOURLY = grid_sql("user_hourly", "user_id")
USER_HOURLY_GAPS = grid_sql("user_hourly", "user_id", "NULL")


def wide_sql(base: str = HOURLY) -> str:
    picks = ", ".join(f"max(value) FILTER (WHERE series_id = '{c}') AS {c}" for c in CHANNELS)
    return f"{base},\nwide AS (SELECT ts, pos, {picks} FROM hourly GROUP BY ts, pos)"


WIDE = wide_sql()
WIDE_GAPS = wide_sql(HOURLY_GAPS)

TICKS = """ticks AS (
  SELECT event_type AS series_id, ts, event_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""

DAILY = """daily_sparse AS (
  SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2),
daily_ticks AS (
  SELECT unnest(generate_series((SELECT min(ts) FROM daily_sparse),
                                (SELECT max(ts) FROM daily_sparse), INTERVAL 1 DAY)) AS ts),
daily AS (
  SELECT s.series_id, t.ts,
         row_number() OVER (PARTITION BY s.series_id ORDER BY t.ts) - 1 AS pos,
         COALESCE(v.value, 0) AS value
  FROM (SELECT DISTINCT series_id FROM daily_sparse) s
  CROSS JOIN daily_ticks t
  LEFT JOIN daily_sparse v ON v.series_id = s.series_id AND v.ts = t.ts)"""
