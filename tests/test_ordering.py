import numpy as np
import pandas as pd
import pytest
from helpers import START, collected, gappy, long_frame, to_spark
from pyspark.sql import functions as F

from tideloom.functions.times import HOUR
from tideloom.operators import ordering, rolling

KEY = ["series_id"]


def irregular(seed=3):
    """One series holds most rows and has many rows with one timestamp."""
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in (("hot", 900), ("a", 40), ("b", 1), ("c", 7)):
        minutes = rng.integers(0, 60, n) if name != "hot" else np.where(rng.random(n) < 0.4, 5, rng.integers(0, 5000, n))
        for m in minutes:
            rows.append((name, START + pd.Timedelta(minutes=int(m)), float(rng.integers(0, 50))))
    frame = pd.DataFrame(rows, columns=["series_id", "ts", "value"])
    frame["row_id"] = np.arange(len(frame))
    return frame


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_row_position_matches_pandas(spark, partitions):
    frame = irregular()
    want = frame.sort_values(["series_id", "ts", "row_id"])
    want["pos"] = want.groupby("series_id").cumcount()
    got = ordering.row_position(to_spark(spark, frame, partitions, seed=partitions), KEY, ["ts", "row_id"])
    got = collected(got, ["row_id"])
    assert got["pos"].tolist() == want.sort_values("row_id")["pos"].tolist()


def test_row_position_over_several_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = irregular()
        rows = ordering.ordered_slices(to_spark(spark, frame), KEY, ["ts", "row_id"])
        assert rows.filter("series_id = 'hot'").select("_slice").distinct().count() > 2
        want = frame.sort_values(["series_id", "ts", "row_id"])
        want["pos"] = want.groupby("series_id").cumcount()
        got = collected(ordering.row_position(to_spark(spark, frame), KEY, ["ts", "row_id"]), ["row_id"])
        assert got["pos"].tolist() == want.sort_values("row_id")["pos"].tolist()
        total = ordering.running_total(to_spark(spark, frame), KEY, ["ts", "row_id"], "value", "total")
        want["total"] = want.groupby("series_id")["value"].cumsum()
        assert collected(total, ["row_id"])["total"].tolist() == want.sort_values("row_id")["total"].tolist()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_grid_position(spark):
    frame = long_frame({"a": np.arange(30), "b": np.arange(5)})
    got = ordering.grid_position(to_spark(spark, frame).withColumnRenamed("pos", "want"), HOUR, KEY)
    assert got.filter("pos <> want").count() == 0


@pytest.mark.parametrize("chunk,before,after", [(7, 3, 0), (7, 0, 4), (5, 12, 9), (100, 4, 4)])
def test_halo_gives_every_chunk_its_neighbours(spark, chunk, before, after):
    n = 41
    rows = ordering.with_halo(to_spark(spark, long_frame({"a": np.arange(n)})), chunk, before, after)
    seen = rows.groupBy("_chunk").agg(F.collect_set("pos").alias("p"), F.count("*").alias("n")).collect()
    for row in seen:
        low, high = row["_chunk"] * chunk - before, (row["_chunk"] + 1) * chunk - 1 + after
        assert row["n"] == len(row["p"])
        assert set(row["p"]) <= set(range(max(low, 0), min(high, n - 1) + 1))
        if row["_chunk"] * chunk < n:
            assert set(row["p"]) == set(range(max(low, 0), min(high, n - 1) + 1))
    assert rows.filter("_home").count() == n


def test_compact_position_closes_holes(spark):
    frame = long_frame({"a": np.arange(50), "b": np.arange(9)})
    kept = frame[frame["value"] % 3 != 1].copy()
    got = collected(ordering.compact_position(to_spark(spark, kept), KEY, chunk=8), ["series_id", "ts"])
    want = kept.groupby("series_id").cumcount()
    assert got["pos"].tolist() == want.tolist()


def test_tail_and_ends(spark):
    frame = long_frame({"a": np.arange(20), "b": np.arange(3)})
    df = to_spark(spark, frame)
    want = frame.groupby("series_id").tail(5).sort_values(["series_id", "pos"])["pos"].tolist()
    assert collected(ordering.keep_last(df, 5, KEY))["pos"].tolist() == want
    assert collected(ordering.tail_n(df, 5, KEY, ["ts"]))["pos"].tolist() == want
    assert collected(ordering.tail_n(df, 2000, KEY, ["ts"]))["pos"].tolist() == frame["pos"].tolist()
    assert collected(ordering.keep_first(df, 2))["pos"].tolist() == [0, 1, 0, 1]


SERIES = {
    "a": gappy(300, 1),
    "gap": np.concatenate([gappy(20, 2), np.full(150, np.nan), gappy(30, 3)]),
    "head": np.concatenate([np.full(40, np.nan), [1.0, 2.0], np.full(40, np.nan)]),
    "none": np.full(25, np.nan),
    "one": np.array([5.0]),
}


@pytest.mark.parametrize("chunk,levels", [(1000, 2), (16, 1), (4, 2)])
def test_fills_match_pandas(spark, chunk, levels):
    frame = long_frame(SERIES)
    df = to_spark(spark, frame)
    by = frame.groupby("series_id")["value"]
    pairs = (
        (rolling.ffill(df, ["value"], KEY, chunk=chunk, levels=levels), by.ffill()),
        (rolling.bfill(df, ["value"], KEY, chunk=chunk, levels=levels), by.bfill()),
        (rolling.fill(df, ["value"], KEY, chunk=chunk), by.ffill().groupby(frame["series_id"]).bfill()),
    )
    for got, want in pairs:
        np.testing.assert_array_equal(collected(got)["value"].to_numpy(dtype=float), want.to_numpy())


@pytest.mark.parametrize("chunk", [6, 50, 1000])
def test_row_features_match_pandas(spark, chunk):
    frame = long_frame(SERIES)
    got = collected(rolling.row_features(to_spark(spark, frame), ["value"], KEY, 5, chunk=chunk))
    by = frame.groupby("series_id")["value"]
    want = {
        "value_lag1": by.shift(1),
        "value_rolling_mean": by.transform(lambda v: v.rolling(5).mean()),
        "value_rolling_std": by.transform(lambda v: v.rolling(5).std()),
    }
    for name, values in want.items():
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), values.to_numpy(), atol=1e-9)
