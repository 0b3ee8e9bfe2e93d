"""One series holds most rows; no task may hold most of the work."""

import numpy as np
import pytest
from helpers import collected
from pyspark.sql import functions as F

from tideloom.models.arima import ar1_fit
from tideloom.operators import ordering, rolling, sampling
from tideloom.operators.quantiles import exact_quantiles
from tideloom.operators.windows import cut_windows

KEY = ["series_id"]
N = 60_000


@pytest.fixture()
def hot(spark):
    """One series of 40,000 rows and 2,000 of 10."""
    small = (F.col("id") - 40_000) % 2_000
    rows = spark.range(N).select(
        F.when(F.col("id") < 40_000, F.lit(-1)).otherwise(small).alias("series_id"),
        F.when(F.col("id") < 40_000, F.col("id")).otherwise(F.floor((F.col("id") - 40_000) / 2_000)).alias("pos"),
        F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise((F.col("id") * 7919) % 1009).cast("double").alias("value"),
        F.col("id").alias("row_id"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows.repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def largest_share(df) -> float:
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_range_slices_split_the_hot_series(spark, hot):
    rows = ordering.ordered_slices(hot, KEY, ["pos"])
    sizes = [r["n"] for r in rows.groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < N * 0.3
    placed = ordering.row_position(hot.withColumnRenamed("pos", "want"), KEY, ["want"])
    assert placed.count() == N and placed.filter("pos <> want").count() == 0


def test_chunks_spread_the_hot_series(spark, hot):
    rows = ordering.spread(ordering.with_halo(hot, 1024, before=4), [*KEY, "_chunk"])
    assert largest_share(rows) < 0.3
    lagged = rolling.lag1(hot, ["value"], KEY, chunk=1024)
    assert lagged.count() == N
    assert lagged.filter("value_lag1 IS NULL").count() == 2_001


def test_heavy_value_is_one_row_of_the_quantiles(spark, hot):
    values = np.array([r.value for r in hot.filter("series_id = -1").select("value").collect()])
    row = exact_quantiles(hot, ["value"], {"q1": 0.25, "q2": 0.5}, KEY).filter("series_id = -1").first()
    assert (row.q1, row.q2) == tuple(np.quantile(values, [0.25, 0.5]))


def test_results_stay_whole(spark, hot):
    windows = cut_windows(hot, ["value"], KEY, 6, 2, chunk=1024)
    assert windows.count() == (40_000 - 8 + 1) + 2_000 * 3
    draws = sampling.weighted_resample(hot.withColumn("w", F.when(F.col("row_id") == 5, 1e7).otherwise(F.col("value"))), "row_id", "w")
    assert draws.agg(F.sum("draws")).first()[0] == N
    fit = collected(ar1_fit(hot, KEY, chunk=1024), KEY)
    assert fit["n_pairs"].sum() == N - 2_001


def test_prefix_sums_by_levels(spark):
    table = spark.range(500).select(F.lit("a").alias("series_id"), F.col("id").alias("at"), (F.col("id") % 7).alias("size"))
    for levels in (0, 1, 2):
        got = collected(ordering.earlier_sum(table, KEY, "at", "size", "before", chunk=6, levels=levels), ["at"])
        want = np.r_[0, np.cumsum(np.arange(500) % 7)[:-1]]
        assert got["before"].tolist() == want.tolist()
