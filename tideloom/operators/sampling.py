"""Seeded draws and shuffles.

Random numbers are hashes of a row's own identifier. A task that runs again after a lost
executor gets the same numbers, which a generator seeded per partition would not promise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tideloom.operators.ordering import BEFORE, SO_FAR, attach, ordered_slices, row_position, running_total

HASH_DIGITS = 13
HASH_RANGE = float(16**HASH_DIGITS)


def row_hash(ids: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def uniform(ids: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the row's identifier and the seed only."""
    digits = F.conv(F.substring(row_hash(ids, seed), 1, HASH_DIGITS), 16, 10)
    return digits.cast("bigint").cast("double") / F.lit(HASH_RANGE)


#: Digits behind the point of a weight, as a share of the largest one.
SHARE_DIGITS = 20


def weighted_draws(df: DataFrame, row_id: str, weight: str, seed: int = 0) -> DataFrame:
    """Draw as many rows as there are, with replacement, in proportion to ``|weight|``.

    Returns ``draw_id, row_id``; every row lends its identifier to one draw. Rows lie end to
    end on a line of length ``sum(|weight|)`` and a draw picks the row its point falls on:
    rows and points are sorted together and each point takes the last row start before it.
    Weights are taken as shares of the largest one, so their scale does not matter, and add in
    fixed point of ``SHARE_DIGITS`` digits, so the line is the same on every run. Rows whose
    weight is NULL, NaN, infinite or 0 are never drawn; without any other there are no draws.
    """
    size = F.abs(F.col(weight).cast("double"))
    finite = (size > 0) & (size < float("inf")) & ~F.isnan(size)
    sizes = df.select(F.col(row_id), F.when(finite, size).alias("_size")).filter("_size IS NOT NULL")
    largest = sizes.agg(F.max("_size").alias("_largest"))
    weights = attach(sizes, largest, []).select(
        row_id, (F.col("_size") / F.col("_largest")).cast(f"decimal(38,{SHARE_DIGITS})").alias("_w")
    ).filter(F.col("_w") > 0)
    line = running_total(weights, [], [row_id], "_w", "_end")
    starts = line.select(
        (F.col("_end") - F.col("_w")).cast("double").alias("_at"),
        F.lit(0).alias("_kind"),
        F.col(row_id).alias("_id"),
    )
    total = weights.agg(F.sum("_w").cast("double").alias("_total"))
    points = attach(df.select(row_id), total, []).filter("_total IS NOT NULL").select(
        (uniform([row_id], seed) * F.col("_total")).alias("_at"),
        F.lit(1).alias("_kind"),
        F.col(row_id).alias("_id"),
    )
    both = ordered_slices(starts.unionByName(points), [], ["_at", "_kind", "_id"])
    start_id = F.when(F.col("_kind") == 0, F.col("_id"))
    edges = both.groupBy("_slice").agg(F.max_by(start_id, F.when(F.col("_kind") == 0, F.col("_idx"))).alias("_edge"))
    edges = edges.withColumn(
        "_edge", F.last("_edge", True).over(Window.orderBy("_slice").rowsBetween(*BEFORE))
    )
    inside = Window.partitionBy("_slice").orderBy("_idx").rowsBetween(*SO_FAR)
    found = both.withColumn("_inside", F.last(start_id, True).over(inside)).join(edges, "_slice")
    return found.filter("_kind = 1").select(
        F.col("_id").alias("draw_id"), F.coalesce("_inside", "_edge").alias(row_id)
    )


def weighted_resample(df: DataFrame, row_id: str, weight: str, seed: int = 0) -> DataFrame:
    """The drawn rows with ``draws``, the number of times each was drawn.

    Counting before the join keeps a row that is drawn very often from becoming a hot key.
    """
    draws = weighted_draws(df, row_id, weight, seed)
    return df.join(draws.groupBy(row_id).agg(F.count("*").alias("draws")), row_id)


def minibatch_assign(
    df: DataFrame, row_id: str, batch_size: int, seed: int = 0, drop_last: bool = True
) -> DataFrame:
    """Shuffle by hash and cut into batches; the last partial batch is dropped by default."""
    hashed = df.withColumn("_hash", row_hash([row_id], seed))
    rows = row_position(hashed, [], ["_hash", row_id], "_place").drop("_hash")
    batch = F.floor(F.col("_place") / F.lit(batch_size)).cast("bigint")
    rows = rows.withColumn("batch", batch).withColumn("slot", F.col("_place") % batch_size)
    if drop_last:
        full = rows.agg(F.floor(F.count("*") / F.lit(batch_size)).cast("bigint").alias("_full"))
        rows = attach(rows, full, []).filter(F.col("batch") < F.col("_full")).drop("_full")
    return rows.drop("_place")
