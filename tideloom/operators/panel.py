"""Resampling and shaping of many series at once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.calendar import calendar_fraction
from tideloom.functions.times import HOUR, bin_start, shift, steps_between
from tideloom.operators.ordering import attach, row_position, series_length, spread
from tideloom.session import settle

GRID_BLOCK = 4096


def resample_sum(
    df: DataFrame,
    keys: Sequence[str],
    period: timedelta = HOUR,
    ts: str = "ts",
    value: str = "value",
    closed: str = "right",
    decimals: int | None = None,
) -> DataFrame:
    """Sum per bin, labelled with the bin's left edge; bins are closed on the right.

    With ``decimals`` the sum runs in fixed point, so it does not depend on the order in
    which partial sums meet. Empty bins appear with ``dense_grid``.
    """
    bins = df.withColumn("_bin", bin_start(F.col(ts), period, closed))
    if decimals is None:
        total = F.sum(value)
    else:
        total = F.sum(F.col(value).cast(f"decimal(28,{decimals})")).cast("double")
    return bins.groupBy(*keys, F.col("_bin").alias(ts)).agg(total.alias(value))


def dense_grid(
    df: DataFrame,
    keys: Sequence[str],
    period: timedelta = HOUR,
    ts: str = "ts",
    fill: float | None = 0.0,
    pos: str = "pos",
) -> DataFrame:
    """Every tick between the first and the last of the table, for every series.

    Also numbers the ticks. The grid is laid out in blocks that are spread over the cluster
    before their ticks are generated: every row makes the ticks up to the next one of its block, so
    that the blocks and rows are shuffled and sorted, and never the ticks. The input, usually a
    fresh aggregate much smaller than what it was made from, is read for its bounds, its keys and
    its values, so it is written once first.
    """
    df = settle(df)
    values = [c for c in df.columns if c not in (*keys, ts)]
    place = [*keys, "_block"]
    bounds = df.agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"))
    series = df.select(*keys).distinct() if keys else bounds.select()
    blocks = attach(series, bounds, [])
    last = steps_between(F.col("_start"), F.col("_end"), period)
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor(last / F.lit(GRID_BLOCK)).cast("bigint"))
    blocks = spread(blocks.withColumn("_last", last).withColumn("_block", F.explode(numbers)).drop("_end"), place)
    rows = attach(df, bounds, []).withColumn("_at", steps_between(F.col("_start"), F.col(ts), period))
    # Rows between two ticks have no place on the grid.
    rows = rows.filter(shift(F.col("_start"), F.col("_at"), period) == F.col(ts))
    rows = spread(rows.withColumn("_block", F.floor(F.col("_at") / F.lit(GRID_BLOCK)).cast("bigint")), place)
    order = Window.partitionBy(*place).orderBy("_at")
    rows = rows.select(*place, "_at", *values, F.lag("_at").over(order).alias("_before"), F.lead("_at").over(order).alias("_next"))
    # Spark sizes the ticks by what they come from. The hint keeps both sides shuffled, whatever a caller filters, and
    # the join lets none of them pass for a small table.
    runs = blocks.join(rows.hint("merge"), place, "left")
    low = F.when(F.col("_before").isNotNull(), F.col("_at")).otherwise(F.col("_block") * GRID_BLOCK)
    end = F.least(F.col("_last"), F.col("_block") * GRID_BLOCK + (GRID_BLOCK - 1))
    # Rows may share a tick: all but the last of them make no other.
    high = F.greatest("_at", F.coalesce(F.col("_next") - 1, end))
    grid = runs.withColumn(pos, F.explode(F.sequence(low, high)))
    cells = {c: F.when(F.col(pos) == F.col("_at"), F.col(c)) for c in values}
    if fill is not None:
        cells = {c: F.coalesce(cell, F.lit(fill)) for c, cell in cells.items()}
    tick = shift(F.col("_start"), F.col(pos), period).alias(ts)
    return grid.select(*keys, tick, pos, *[cell.alias(c) for c, cell in cells.items()])


def first_active(
    df: DataFrame, keys: Sequence[str], value: str = "value", pos: str = "pos", name: str = "first_pos"
) -> DataFrame:
    """Position of the first non-zero value per series; 0 for an all-zero series."""
    found = F.min(F.when(F.col(value) != 0, F.col(pos)))
    return df.groupBy(*keys).agg(F.coalesce(found, F.lit(0)).alias(name))


def late_series_filter(
    df: DataFrame, keys: Sequence[str], limit: int = 10_000, value: str = "value", pos: str = "pos"
) -> DataFrame:
    """Keep the series whose first activity comes before position ``limit``."""
    kept = first_active(df, keys, value, pos).filter(F.col("first_pos") < limit)
    return df.join(kept, list(keys), "left_semi")


def common_start_trim(
    df: DataFrame, keys: Sequence[str], value: str = "value", pos: str = "pos"
) -> DataFrame:
    """Start every series at the latest first activity of all, counted from 0 again."""
    latest = first_active(df, keys, value, pos).agg(F.max("first_pos").alias("_from"))
    rows = attach(df, latest, []).filter(F.col(pos) >= F.col("_from"))
    return rows.withColumn(pos, F.col(pos) - F.col("_from")).drop("_from")


def panel_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str = "ts"
) -> DataFrame:
    """Number the rows of every key group by time and add weekday, hour and month fractions."""
    return row_position(df, keys, order).withColumns(calendar_fraction(F.col(ts)))


def panel_quality_filter(
    df: DataFrame,
    keys: Sequence[str],
    max_zero_share: float = 0.2,
    min_length: int = 3000,
    value: str = "value",
) -> DataFrame:
    """Drop series with too many zeros or too few rows."""
    quality = df.groupBy(*keys).agg(
        F.avg((F.col(value) == 0).cast("int")).alias("zero_share"), F.count("*").alias("n_rows")
    )
    good = quality.filter((F.col("zero_share") <= max_zero_share) & (F.col("n_rows") >= min_length))
    return df.join(good, list(keys), "left_semi")


def tail_align(
    df: DataFrame, keys: Sequence[str], cap: int | None = None, pos: str = "pos"
) -> DataFrame:
    """Cut all series to the shortest length (at most ``cap``, if given), keeping the newest rows."""
    sizes = settle(series_length(df, keys))
    shortest = sizes.agg(F.least(F.min("n_rows"), F.lit(cap).cast("long")).alias("_keep"))
    rows = attach(attach(df, sizes, keys), shortest, []).withColumn(pos, F.col(pos) - F.col("n_rows") + F.col("_keep"))
    return rows.filter(F.col(pos) >= 0).drop("n_rows", "_keep")


#: The column that takes in what has no column of its own.
OTHER = "other"


def channel_label(key: str) -> Column:
    """A series' name as a column name: dots and backticks become underscores."""
    return F.translate(F.col(key).cast("string"), ".`", "__")


def channel_names(df: DataFrame, key: str = "series_id", limit: int = 64) -> list[str]:
    """The names of the series found in ``df``, in order: columns for ``as_channels``.

    At most ``limit`` of them, those with the most rows; if there are more, or rows without a name,
    ``OTHER`` comes last and stands for the rest. The driver receives ``limit + 1`` short rows.
    """
    counts = df.groupBy(channel_label(key).alias("_name")).agg(F.count("*").alias("_n"))
    top = counts.where("_name IS NOT NULL").orderBy(F.desc("_n"), "_name").limit(limit + 1)
    found = [r["_name"] for r in top.collect()]
    rest = len(found) > limit or not counts.where("_name IS NULL").isEmpty()
    names = sorted(set(found[:limit]) - {OTHER})
    return names + [OTHER] if rest or OTHER in found else names


def as_channels(df: DataFrame, names: Sequence[str], key: str = "series_id") -> DataFrame:
    """``key`` as one of ``names``: rows of any other series, or of none, belong to ``OTHER``."""
    label = channel_label(key)
    return df.withColumn(key, F.when(label.isin(*names), label).otherwise(F.lit(OTHER)))


def panel_pivot(
    df: DataFrame, series: Sequence[str], key: str = "series_id", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Long to wide: one row per tick and one column per listed series."""
    return df.groupBy(ts).pivot(key, list(series)).agg(F.first(value))


def panel_unpivot(
    df: DataFrame, series: Sequence[str], key: str = "series_id", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Wide to long."""
    return df.unpivot([ts], list(series), key, value)


def series_covariates(
    df: DataFrame, keys: Sequence[str], name: str = "series_index", unit: str = "series_unit"
) -> DataFrame:
    """Index of the series in key order, and the same as ``index / series - 0.5``."""
    index = row_position(df.select(*keys).distinct(), [], list(keys), name)
    index = attach(index, index.agg(F.count("*").alias("_series")), [])
    index = index.withColumn(unit, F.col(name) / F.col("_series") - F.lit(0.5)).drop("_series")
    return attach(df, index, keys)
