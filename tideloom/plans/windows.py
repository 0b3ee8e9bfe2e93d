"""Queries for training windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.operators import sampling
from tideloom.operators.ordering import row_position, with_length
from tideloom.operators.windows import (
    append_predict_token,
    cut_windows,
    patching,
    pyramid_gather,
    pyramid_levels,
    pyramid_pool,
    single_step_expand,
    strided_panel_windows,
    windows_with_marks,
    windows_with_time_features,
    zero_pad_front,
)
from tideloom.plans.base import (
    CHUNK,
    KEY,
    USER_HOURLY,
    USER_HOURLY_GAPS,
    events,
    rounded,
    table,
    user_hourly,
)
from tideloom.plans.features import GROUPED
from tideloom.plans.registry import register


def total(column, field: str | None = None):
    """Sum of an array, or of one field of an array of structs."""
    values = F.col(column).getField(field) if field else F.col(column)
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


@register(
    "sliding_windows",
    f"""WITH {USER_HOURLY}
SELECT series_id, pos AS window_id, round(sum(value) OVER p, 6) AS past_sum, last_value(value) OVER p AS past_last,
  round(sum(value) OVER f, 6) AS future_sum, last_value(value) OVER f AS future_last
FROM user_hourly
WINDOW p AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING),
       f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 24 FOLLOWING AND 29 FOLLOWING)
QUALIFY count(*) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) = 30""",
)
def sliding_windows(spark, sf_dir):
    windows = cut_windows(user_hourly(spark, sf_dir), ["value"], KEY, 24, 6, chunk=CHUNK)
    return windows.select(
        "series_id",
        "window_id",
        rounded(total("past")).alias("past_sum"),
        F.element_at("past", -1).alias("past_last"),
        rounded(total("future")).alias("future_sum"),
        F.element_at("future", -1).alias("future_last"),
    )


@register(
    "windows_with_time_features",
    f"""WITH {USER_HOURLY_GAPS}, marked AS (
  SELECT *, cos(2.0::DOUBLE * pi() * day(ts) / 31.0::DOUBLE) AS day_cos, sin(2.0::DOUBLE * pi() * (isodow(ts) - 1) / 7.0::DOUBLE) AS weekday_sin
  FROM user_hourly)
SELECT series_id, pos AS window_id, count(value) OVER p AS observed, round(sum(COALESCE(value, 0)) OVER p, 6) AS past_sum,
  round(sum(day_cos) OVER p, 6) AS past_day_cos, round(sum(weekday_sin) OVER f, 6) + 0.0 AS future_weekday_sin
FROM marked
WINDOW p AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING),
       f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 24 FOLLOWING AND 29 FOLLOWING)
QUALIFY count(*) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) = 30""",
)
def windows_with_time_features_query(spark, sf_dir):
    rows = user_hourly(spark, sf_dir, fill=None)
    windows = windows_with_time_features(rows, ["value"], KEY, 24, 6, chunk=CHUNK)
    return windows.select(
        "series_id",
        "window_id",
        F.aggregate("past_observed_mask", F.lit(0), lambda a, v: a + v).cast("bigint").alias("observed"),
        rounded(total("past", "value")).alias("past_sum"),
        rounded(total("past", "day_cos")).alias("past_day_cos"),
        (rounded(total("future", "weekday_sin")) + F.lit(0.0)).alias("future_weekday_sin"),
    )


@register(
    "windows_with_marks",
    f"""WITH {USER_HOURLY},
params AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS raw FROM user_hourly WHERE pos < 288 GROUP BY 1),
spans(split, low, high) AS (VALUES ('train', 0, 288), ('valid', 240, 384), ('test', 336, 480)),
rows AS (
  SELECT u.series_id, split, pos - low AS pos, value AS plain,
         (value - m) / CASE WHEN raw = 0 THEN 1 ELSE raw END AS value, hour(ts) / 23.0::DOUBLE - 0.5::DOUBLE AS mark
  FROM user_hourly u JOIN params USING (series_id) JOIN spans ON pos >= low AND pos < high)
SELECT series_id, split, pos AS window_id, round(sum(value) OVER p, 6) + 0.0 AS past_sum, round(sum(plain) OVER f, 6) AS future_sum,
  round(sum(mark) OVER p, 6) + 0.0 AS past_mark, round(sum(mark) OVER f, 6) + 0.0 AS future_mark
FROM rows
WINDOW p AS (PARTITION BY series_id, split ORDER BY pos ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING),
       f AS (PARTITION BY series_id, split ORDER BY pos ROWS BETWEEN 48 FOLLOWING AND 71 FOLLOWING)
QUALIFY count(*) OVER (PARTITION BY series_id, split ORDER BY pos ROWS BETWEEN CURRENT ROW AND 71 FOLLOWING) = 72""",
)
def windows_with_marks_query(spark, sf_dir):
    rows = user_hourly(spark, sf_dir)
    windows = windows_with_marks(rows, ["value"], KEY, 48, 24, month_days=1, inverse=True, chunk=CHUNK)
    return windows.select(
        "series_id",
        "split",
        "window_id",
        (rounded(total("past", "value")) + F.lit(0.0)).alias("past_sum"),
        rounded(total("future", "value")).alias("future_sum"),
        (rounded(total("past_marks", "hour_of_day")) + F.lit(0.0)).alias("past_mark"),
        (rounded(total("future_marks", "hour_of_day")) + F.lit(0.0)).alias("future_mark"),
    )


@register(
    "strided_panel_windows",
    f"""WITH {USER_HOURLY}, lengths AS (SELECT series_id, count(*) AS n FROM user_hourly GROUP BY 1),
borders AS (SELECT series_id, n, CAST(floor(n::DOUBLE * 0.8::DOUBLE) AS BIGINT) AS train_end FROM lengths),
parts AS (
  SELECT series_id, 'train' AS split, 0 AS first, (train_end - 72) // 24 AS windows FROM borders
  UNION ALL SELECT series_id, 'test', train_end - 48 + 1, (n - (train_end - 48 + 1) - 72) // 24 FROM borders),
starts AS (SELECT series_id, split, first, unnest(generate_series(0, windows - 1)) AS window_id FROM parts)
SELECT s.series_id, s.split, s.window_id, min(u.pos) AS start, round(sum(value) FILTER (WHERE pos < first + window_id * 24 + 48), 6) AS past_sum,
  round(sum(value) FILTER (WHERE pos >= first + window_id * 24 + 48), 6) AS future_sum
FROM starts s JOIN user_hourly u ON u.series_id = s.series_id AND pos >= first + window_id * 24 AND pos < first + window_id * 24 + 72
GROUP BY 1, 2, 3""",
)
def strided_panel_windows_query(spark, sf_dir):
    rows = with_length(user_hourly(spark, sf_dir), KEY)
    rows = rows.withColumn("train_end", F.floor(F.col("n_rows").cast("double") * F.lit(0.8)))
    rows = rows.withColumn("test_start", F.col("train_end") - 48 + 1)
    train = strided_panel_windows(rows, KEY, 48, 24, end="train_end", chunk=CHUNK)
    test = strided_panel_windows(rows, KEY, 48, 24, end="n_rows", first="test_start", chunk=CHUNK)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select(
        "series_id",
        "split",
        "window_id",
        "start",
        rounded(total("past")).alias("past_sum"),
        rounded(total("future")).alias("future_sum"),
    )


# Hours without events are missing rows here, not zeros; positions still count all hours.
HOLED = f"""{USER_HOURLY_GAPS}, holed AS (SELECT series_id, pos, value FROM user_hourly WHERE value IS NOT NULL OR pos % 5 < 3)"""


def holed(spark, sf_dir):
    return user_hourly(spark, sf_dir, fill=None).filter("value IS NOT NULL OR pos % 5 < 3")


def cells(windows, kept):
    """A row per cell of every window; ``step`` counts from the window's first row."""
    both = F.posexplode(F.concat("past", "future")).alias("step", "value")
    return windows.select(*kept, both)


@register(
    "sliding_window_cells",
    f"""WITH {HOLED}, runs AS (
  SELECT series_id, pos, value, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS island FROM holed),
starts AS (
  SELECT series_id, pos AS start, count(*) OVER (PARTITION BY series_id, island ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS room FROM runs)
SELECT s.series_id, s.start AS window_id, CAST(h.pos - s.start AS INTEGER) AS step, h.value
FROM starts s JOIN holed h ON h.series_id = s.series_id AND h.pos >= s.start AND h.pos < s.start + 8 WHERE s.room = 8""",
)
def sliding_window_cells(spark, sf_dir):
    """Windows of six hours and two over rows with holes, cell by cell."""
    windows = cut_windows(holed(spark, sf_dir), ["value"], KEY, 6, 2, chunk=CHUNK)
    return cells(windows, ["series_id", "window_id"])


@register(
    "strided_window_cells",
    f"""WITH {HOLED}, bounds AS (SELECT series_id, 3 AS first, max(pos) + 1 AS n FROM holed GROUP BY 1),
starts AS (SELECT series_id, first, unnest(generate_series(0, (n - first - 8) // 4 - 1)) AS window_id FROM bounds),
found AS (
  SELECT s.series_id, s.window_id, first + window_id * 4 AS start, h.pos, h.value, count(*) OVER (PARTITION BY s.series_id, s.window_id) AS n
  FROM starts s JOIN holed h ON h.series_id = s.series_id AND h.pos >= first + window_id * 4 AND h.pos < first + window_id * 4 + 8)
SELECT series_id, window_id, start, CAST(pos - start AS INTEGER) AS step, value FROM found WHERE n = 8""",
)
def strided_window_cells(spark, sf_dir):
    """Every fourth window from position 3 on, cell by cell; holes take windows out, not their numbers."""
    rows = holed(spark, sf_dir)
    ends = rows.groupBy(*KEY).agg((F.max("pos") + 1).alias("end"))
    rows = rows.join(ends, KEY).withColumn("first", F.lit(3).cast("bigint"))
    windows = strided_panel_windows(rows, KEY, 6, 2, end="end", first="first", stride=4, chunk=CHUNK)
    return cells(windows, ["series_id", "window_id", "start"])


@register(
    "zero_pad_front",
    f"""WITH {GROUPED},
shape AS (
  SELECT event_type, user_id, count(*) AS n, min(ts) FILTER (WHERE pos = 0) AS t0, min(ts) FILTER (WHERE pos = 1) AS t1
  FROM grouped GROUP BY 1, 2)
SELECT event_type, user_id, pos + greatest(16 - n, 0) AS pos, ts, value, FALSE AS padded FROM grouped JOIN shape USING (event_type, user_id)
UNION ALL
SELECT event_type, user_id, back_pos, make_timestamp(epoch_us(t0) - (16 - n - back_pos) * (epoch_us(t1) - epoch_us(t0))), 0, TRUE
FROM (SELECT *, unnest(generate_series(0, 15 - n)) AS back_pos FROM shape WHERE n < 16)""",
)
def zero_pad_front_query(spark, sf_dir):
    keys = ["event_type", "user_id"]
    rows = row_position(events(spark, sf_dir), keys, ["ts", "event_id"])
    return zero_pad_front(rows, keys, 16, ["value"]).select(*keys, "pos", "ts", "value", "padded")


# Windows of 48 hours at stride 24 with the hour of day beside each value.
MARKED_CELLS = f"""{USER_HOURLY}, lengths AS (SELECT series_id, count(*) AS n FROM user_hourly GROUP BY 1),
starts AS (SELECT series_id, unnest(generate_series(0, (n - 48) // 24)) AS window_id FROM lengths),
cells AS (
  SELECT s.series_id, s.window_id, u.pos - s.window_id * 24 AS slot, u.value, hour(u.ts) / 24.0::DOUBLE AS mark
  FROM starts s JOIN user_hourly u ON u.series_id = s.series_id AND u.pos >= s.window_id * 24 AND u.pos < s.window_id * 24 + 48)"""


def marked_windows(spark, sf_dir, context, horizon):
    rows = user_hourly(spark, sf_dir).withColumn("mark", F.hour("ts") / F.lit(24.0))
    return cut_windows(rows, ["value", "mark"], KEY, context, horizon, stride=24, chunk=CHUNK)


@register(
    "single_step_expand",
    f"""WITH {MARKED_CELLS}
SELECT c.series_id, c.window_id, k.step, round(sum(value) FILTER (WHERE slot < k.step + 44) - 1, 6) AS masked_sum,
  max(value) FILTER (WHERE slot = k.step + 44) AS label, round(sum(mark), 6) AS mark_sum
FROM cells c CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS step) k
WHERE slot >= k.step AND slot <= k.step + 44 GROUP BY 1, 2, 3""",
)
def single_step_expand_query(spark, sf_dir):
    windows = marked_windows(spark, sf_dir, 44, 4)
    both = F.concat("past", "future")
    windows = windows.select(
        "series_id",
        "window_id",
        F.transform(both, lambda r: r["value"]).alias("values"),
        F.transform(both, lambda r: r["mark"]).alias("marks"),
    )
    rows = single_step_expand(windows, "values", 4, ["marks"])
    return rows.select(
        "series_id",
        "window_id",
        "step",
        rounded(total("values")).alias("masked_sum"),
        "label",
        rounded(total("marks")).alias("mark_sum"),
    )


@register(
    "append_predict_token",
    f"""WITH {MARKED_CELLS}
SELECT series_id, window_id, 45 AS length, 0.0::DOUBLE AS last_value, round(sum(value) FILTER (WHERE slot < 44), 6) AS past_sum,
  round(sum(mark) FILTER (WHERE slot <= 44), 6) AS mark_sum FROM cells GROUP BY 1, 2""",
)
def append_predict_token_query(spark, sf_dir):
    windows = marked_windows(spark, sf_dir, 44, 4).select(
        "series_id",
        "window_id",
        F.transform("past", lambda r: r["value"]).alias("past"),
        F.transform("past", lambda r: r["mark"]).alias("past_marks"),
        F.transform("future", lambda r: r["mark"]).alias("future_marks"),
    )
    rows = append_predict_token(windows, "past", "past_marks", "future_marks")
    return rows.select(
        "series_id",
        "window_id",
        F.size("past").alias("length"),
        F.element_at("past", -1).alias("last_value"),
        rounded(total("past")).alias("past_sum"),
        rounded(total("past_marks")).alias("mark_sum"),
    )


@register(
    "patching",
    """SELECT vec_id, (pos - 17) // 24 AS patch_id, count(*) AS n, round(sum(embedding[pos]::DOUBLE), 6) + 0.0 AS patch_sum,
  round(max(embedding[pos]::DOUBLE), 6) AS patch_max
FROM (SELECT vec_id, embedding, unnest(generate_series(17, 64)) AS pos FROM embeddings) GROUP BY 1, 2""",
)
def patching_query(spark, sf_dir):
    values = F.transform("embedding", lambda v: v.cast("double"))
    rows = patching(table(spark, sf_dir, "embeddings").select("vec_id", values.alias("past")), 24)
    return rows.select(
        "vec_id",
        F.col("patch_id").cast("bigint").alias("patch_id"),
        F.size("patch").cast("bigint").alias("n"),
        (rounded(total("patch")) + F.lit(0.0)).alias("patch_sum"),
        rounded(F.array_max("patch")).alias("patch_max"),
    )


PYRAMID = f"""{USER_HOURLY}, pyramid AS (
  SELECT series_id, level, pos // span AS idx, avg(value) AS mean, max(value) AS peak
  FROM user_hourly CROSS JOIN (VALUES (0, 1), (1, 4), (2, 16), (3, 64)) l(level, span)
  GROUP BY series_id, level, span, idx HAVING count(*) = span)"""


@register(
    "pyramid_pool",
    f"WITH {PYRAMID} SELECT series_id, level, idx, round(mean, 8) AS mean, peak FROM pyramid",
)
def pyramid_pool_query(spark, sf_dir):
    both = pyramid_levels(user_hourly(spark, sf_dir), KEY)
    return both.select(*KEY, "level", "idx", rounded("mean", 8).alias("mean"), "peak")


@register(
    "pyramid_gather",
    f"""WITH {PYRAMID}, sizes AS (SELECT series_id, level, count(*) AS n FROM pyramid GROUP BY 1, 2),
chain AS (
  SELECT b.series_id, b.idx, b.mean AS value_0, least(b.idx // 4, s1.n - 1) AS i1, s2.n AS n2, s3.n AS n3
  FROM pyramid b JOIN sizes s1 ON s1.series_id = b.series_id AND s1.level = 1
  JOIN sizes s2 ON s2.series_id = b.series_id AND s2.level = 2 JOIN sizes s3 ON s3.series_id = b.series_id AND s3.level = 3
  WHERE b.level = 0),
deeper AS (SELECT *, least(i1 // 4, n2 - 1) AS i2, least(least(i1 // 4, n2 - 1) // 4, n3 - 1) AS i3 FROM chain)
SELECT d.series_id, d.idx, round(value_0, 8) AS value_0, round(p1.mean, 8) AS value_1, round(p2.mean, 8) AS value_2, round(p3.mean, 8) AS value_3
FROM deeper d JOIN pyramid p1 ON p1.series_id = d.series_id AND p1.level = 1 AND p1.idx = i1
JOIN pyramid p2 ON p2.series_id = d.series_id AND p2.level = 2 AND p2.idx = i2
JOIN pyramid p3 ON p3.series_id = d.series_id AND p3.level = 3 AND p3.idx = i3""",
)
def pyramid_gather_query(spark, sf_dir):
    rows = pyramid_gather(pyramid_pool(user_hourly(spark, sf_dir), KEY), KEY)
    return rows.select(*KEY, "idx", *[rounded(f"value_{i}", 8).alias(f"value_{i}") for i in range(4)])


UNIFORM_SQL = "('0x' || substr(md5(concat_ws('-', '{seed}', CAST(event_id AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@register(
    "weighted_resample",
    f"""WITH line AS (
  SELECT event_id, event_type, CAST(sum(CAST(abs(value) AS DECIMAL(28,6))) OVER (ORDER BY event_id) - CAST(abs(value) AS DECIMAL(28,6)) AS DOUBLE) AS start
  FROM events WHERE abs(value) > 0),
total AS (SELECT CAST(sum(CAST(abs(value) AS DECIMAL(28,6))) AS DOUBLE) AS t FROM events),
points AS (SELECT {UNIFORM_SQL.format(seed=7)} * t AS u FROM events CROSS JOIN total)
SELECT line.event_id, line.event_type, count(*) AS draws FROM points ASOF JOIN line ON points.u >= line.start GROUP BY 1, 2""",
)
def weighted_resample_query(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    return sampling.weighted_resample(rows, "event_id", "value", seed=7).select("event_id", "event_type", "draws")


@register(
    "minibatch_assign",
    """WITH placed AS (
  SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws('-', '7', CAST(event_id AS VARCHAR))), event_id) - 1 AS place,
         count(*) OVER () AS n FROM events)
SELECT event_id, place // 32 AS batch, place % 32 AS slot FROM placed WHERE place // 32 < n // 32""",
)
def minibatch_assign_query(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id")
    return sampling.minibatch_assign(rows, "event_id", 32, seed=7).select("event_id", "batch", "slot")
