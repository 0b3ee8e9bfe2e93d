"""Row-window features and gap filling, chunk by chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.operators.ordering import (
    CHUNK,
    FROM_HERE,
    SO_FAR,
    attach,
    chunk_of,
    chunk_window,
    drop_halo,
    with_halo,
)


def lag_column(c: str, keys: Sequence[str], pos: str = "pos", steps: int = 1) -> Column:
    return F.lag(c, steps).over(chunk_window(keys, pos))


def rolling_columns(c: str, keys: Sequence[str], width: int, pos: str = "pos") -> tuple[Column, Column]:
    """Mean and sample deviation of the last ``width`` rows, NULL unless all are present."""
    frame = chunk_window(keys, pos).rowsBetween(1 - width, 0)
    full = F.count(c).over(frame) == width
    return (
        F.when(full, F.avg(c).over(frame)),
        F.when(full, F.stddev_samp(c).over(frame)),
    )


def row_features(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    width: int = 5,
    pos: str = "pos",
    chunk: int = CHUNK,
) -> DataFrame:
    """``<c>_lag1``, ``<c>_rolling_mean`` and ``<c>_rolling_std`` of every channel, in one sort."""
    rows = with_halo(df, chunk, before=max(width - 1, 1), pos=pos, keys=keys)
    added = []
    for c in cols:
        mean, std = rolling_columns(c, keys, width, pos)
        added += [
            lag_column(c, keys, pos).alias(f"{c}_lag1"),
            mean.alias(f"{c}_rolling_mean"),
            std.alias(f"{c}_rolling_std"),
        ]
    return drop_halo(rows.select("*", *added))


def lag1(df: DataFrame, cols: Sequence[str], keys: Sequence[str], pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    rows = with_halo(df, chunk, before=1, pos=pos, keys=keys)
    return drop_halo(rows.select("*", *[lag_column(c, keys, pos).alias(f"{c}_lag1") for c in cols]))


def rolling_mean(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], width: int = 5, pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    rows = with_halo(df, chunk, before=width - 1, pos=pos, keys=keys)
    added = [rolling_columns(c, keys, width, pos)[0].alias(f"{c}_rolling_mean") for c in cols]
    return drop_halo(rows.select("*", *added))


def rolling_std(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], width: int = 5, pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    rows = with_halo(df, chunk, before=width - 1, pos=pos, keys=keys)
    added = [rolling_columns(c, keys, width, pos)[1].alias(f"{c}_rolling_std") for c in cols]
    return drop_halo(rows.select("*", *added))


def _carry(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], pos: str, chunk: int, levels: int, forward: bool
) -> DataFrame:
    """Nearest non-null value at or before (after) each position.

    Inside a chunk this is a window; across chunks the nearest value comes from a table with
    one row per chunk, which is filled the same way one level up.
    """
    frame = SO_FAR if forward else FROM_HERE
    nearest = F.last if forward else F.first
    if levels == 0:
        window = Window.partitionBy(*keys).orderBy(pos).rowsBetween(*frame)
        return df.withColumns({c: nearest(c, True).over(window) for c in cols})

    # Rows that a join has put together by series are dealt out by chunk again.
    rows = df.withColumn("_chunk", chunk_of(pos, chunk)).repartition(*keys, "_chunk")
    edge = F.max_by if forward else F.min_by
    summary = rows.groupBy(*keys, "_chunk").agg(
        *[edge(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(c) for c in cols]
    )
    above = _carry(summary.withColumnRenamed("_chunk", pos), cols, keys, pos, chunk, levels - 1, forward)
    carried = above.select(
        *keys,
        (F.col(pos) + (1 if forward else -1)).alias("_chunk"),
        *[F.col(c).alias(f"_carry_{c}") for c in cols],
    )
    window = chunk_window(keys, pos).rowsBetween(*frame)
    inside = rows.withColumns({c: nearest(c, True).over(window) for c in cols})
    joined = inside.join(carried, [*keys, "_chunk"], "left")
    return joined.select(
        *[F.coalesce(c, f"_carry_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def ffill(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    pos: str = "pos",
    chunk: int = CHUNK,
    levels: int = 2,
) -> DataFrame:
    """Last non-null value so far. ``pos`` must be dense (0, 1, 2, …) inside a series."""
    return _carry(df, cols, keys, pos, chunk, levels, forward=True)


def bfill(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    pos: str = "pos",
    chunk: int = CHUNK,
    levels: int = 2,
) -> DataFrame:
    """Next non-null value."""
    return _carry(df, cols, keys, pos, chunk, levels, forward=False)


def first_present(df: DataFrame, cols: Sequence[str], keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """First non-null value of every column per series, as ``_first_<c>``."""
    return df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_first_{c}") for c in cols]
    )


def fill_head(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    pos: str = "pos",
    firsts: DataFrame | None = None,
) -> DataFrame:
    """Give the missing rows of a series its first present value, column by column.

    After ``ffill`` only rows ahead of the first present value can be missing, so this is
    ``bfill`` for that case at the price of one aggregation (or none when ``firsts`` is given).
    """
    rows = attach(df, first_present(df, cols, keys, pos) if firsts is None else firsts, keys)
    return rows.select(
        *[F.coalesce(c, f"_first_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def fill(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """Forward fill, then backward fill of what is left at the head."""
    firsts = first_present(df, cols, keys, pos)
    return fill_head(ffill(df, cols, keys, pos, chunk), cols, keys, pos, firsts)
