import numpy as np
import pandas as pd
import pytest
from helpers import START, collected, gappy, long_frame, to_spark
from pyspark.sql import functions as F

from tideloom.functions.calendar import calendar_by_freq, frequency_name
from tideloom.functions.times import HOUR
from tideloom.operators import filters, panel, scaling, splits
from tideloom.operators.features import feature_matrix, feature_names
from tideloom.operators.quantiles import exact_quantiles

KEY = ["series_id"]


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(0)
    values = np.where(rng.random(997) < 0.35, 0.0, rng.normal(size=997).round(2))
    frame = long_frame({"a": values, "b": gappy(60, 5), "c": np.array([3.0])})
    got = exact_quantiles(to_spark(spark, frame), ["value"], {"q1": 0.25, "q2": 0.5, "q3": 0.75}, KEY)
    want = frame.groupby("series_id")["value"].quantile([0.25, 0.5, 0.75]).unstack()
    got = collected(got, KEY)
    np.testing.assert_allclose(got[["q1", "q2", "q3"]].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_iqr_filter_keeps_missing(spark):
    rng = np.random.default_rng(1)
    frame = long_frame({"a": rng.normal(size=200)})
    frame["other"] = rng.normal(size=200)
    frame.loc[3, "value"], frame.loc[5, "other"], frame.loc[9, "value"] = np.nan, np.nan, 99.0
    numeric = frame[["value", "other"]]
    q1, q3 = numeric.quantile(0.25), numeric.quantile(0.75)
    outside = ((numeric < q1 - 1.5 * (q3 - q1)) | (numeric > q3 + 1.5 * (q3 - q1))).any(axis=1)
    got = collected(filters.iqr_filter(to_spark(spark, frame), ["value", "other"]))
    assert got["pos"].tolist() == frame.loc[~outside, "pos"].tolist()


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "value double")
    row = scaling.fit_standard(df, ["value"]).first()
    assert row["value__center"] == 2.0
    assert filters.numeric_cast(df, ["value"]).agg(F.sum("value")).first()[0] == 4.0


@pytest.mark.parametrize("fit", [scaling.fit_minmax, scaling.fit_standard, scaling.fit_robust])
def test_scale_round_trip_and_constant_channel(spark, fit):
    frame = long_frame({"a": np.arange(20.0), "const": np.full(8, 4.0)})
    df = to_spark(spark, frame)
    params = fit(df, ["value"], KEY)
    scaled = scaling.scale(df, params, ["value"], KEY)
    assert scaled.filter("series_id = 'const' AND value <> 0").count() == 0
    back = collected(scaling.unscale(scaled, params, ["value"], KEY))
    np.testing.assert_allclose(back["value"], frame["value"])


@pytest.mark.parametrize("n", [1, 7, 10, 99, 290])
def test_splits_truncate_like_python(spark, n):
    df = to_spark(spark, long_frame({"a": np.arange(n)}))
    counts = dict(splits.split_three_way(df, KEY).groupBy("split").count().collect())
    train, valid = int(n * 0.7), int(n * 0.2)
    assert counts.get("train", 0) == train and counts.get("valid", 0) == valid
    assert counts.get("test", 0) == n - train - valid
    two = dict(splits.split_train_test(df, KEY).groupBy("split").count().collect())
    assert two.get("train", 0) == int(n * 0.8) and sum(two.values()) == n


def test_overlapping_split(spark):
    n, context = 100, 12
    df = to_spark(spark, long_frame({"a": np.arange(n)}))
    rows = splits.split_overlap(df, KEY, context).groupBy("split").agg(F.min("pos"), F.max("pos")).collect()
    bounds = {r[0]: (r[1], r[2]) for r in rows}
    assert bounds == {"train": (0, 69), "valid": (70 - context, 79), "test": (80 - context, 99)}


def test_calendar_frequencies():
    from itertools import product

    assert [frequency_name(f) for f in ("12H", "5min", "1D", "W-SUN", "QE")] == ["hour", "minute", "day", "week", "quarter"]
    for bad, _ in product(("MS", "ms", "", "2X"), [0]):
        with pytest.raises(ValueError):
            frequency_name(bad)


def test_calendar_features_match_pandas(spark):
    frame = long_frame({"a": np.zeros(24 * 40)})
    frame["ts"] = pd.date_range("2023-12-20 00:17:05", periods=len(frame), freq="h")
    columns = calendar_by_freq(F.col("ts"), "s")
    got = collected(to_spark(spark, frame).select("series_id", "pos", *[c.alias(n) for n, c in columns.items()]))
    ts = frame["ts"].dt
    want = {
        "second_of_minute": ts.second / 59.0 - 0.5,
        "minute_of_hour": ts.minute / 59.0 - 0.5,
        "hour_of_day": ts.hour / 23.0 - 0.5,
        "day_of_week": ts.dayofweek / 6.0 - 0.5,
        "day_of_month": (ts.day - 1) / 30.0 - 0.5,
        "day_of_year": (ts.dayofyear - 1) / 365.0 - 0.5,
    }
    assert list(columns) == list(want)
    for name, values in want.items():
        np.testing.assert_allclose(got[name], values)


def test_resample_matches_pandas_with_exact_hours(spark):
    rng = np.random.default_rng(4)
    minutes = np.sort(rng.integers(0, 600, 80)).tolist() + [60, 120, 120, 540]
    frame = pd.DataFrame({"series_id": "a", "ts": [START + pd.Timedelta(minutes=int(m)) for m in minutes]})
    frame["value"] = rng.integers(1, 100, len(frame)) / 4
    want = frame.set_index("ts")["value"].resample("1h", label="left", closed="right").sum()
    rows = panel.resample_sum(to_spark(spark, frame), KEY, HOUR)
    got = collected(panel.dense_grid(rows, KEY, HOUR))
    assert got["value"].tolist() == want.tolist()
    assert got["ts"].tolist() == want.index.tolist()


def test_dense_grid_spans_blocks_and_series(spark, monkeypatch):
    monkeypatch.setattr(panel, "GRID_BLOCK", 16)
    frame = long_frame({"a": np.arange(100), "b": np.arange(100)})
    kept = frame[(frame["value"] % 7 != 3) | frame["pos"].isin([0, 99])].drop(columns="pos")
    got = collected(panel.dense_grid(to_spark(spark, kept), KEY, HOUR, fill=None))
    assert got["pos"].tolist() == frame["pos"].tolist()
    assert got["ts"].tolist() == frame["ts"].tolist()


def test_panel_filters(spark):
    frame = long_frame(
        {
            "zero": np.zeros(30),
            "late": np.r_[np.zeros(25), np.ones(5)],
            "early": np.r_[0.0, np.ones(29)],
            "short": np.ones(6),
        }
    )
    df = to_spark(spark, frame)
    first = {r[0]: r[1] for r in panel.first_active(df, KEY).collect()}
    assert first == {"zero": 0, "late": 25, "early": 1, "short": 0}
    kept = panel.late_series_filter(df, KEY, limit=10)
    assert {r[0] for r in kept.select("series_id").distinct().collect()} == {"zero", "early", "short"}
    trimmed = collected(panel.common_start_trim(kept, KEY))
    assert trimmed.groupby("series_id")["pos"].agg(["min", "max"]).loc["early"].tolist() == [0, 28]
    good = panel.panel_quality_filter(df, KEY, min_length=10)
    assert {r[0] for r in good.select("series_id").distinct().collect()} == {"early"}
    aligned = collected(panel.tail_align(df, KEY))
    assert aligned.groupby("series_id")["pos"].agg(["min", "max"]).values.tolist() == [[0, 5]] * 4
    assert aligned[aligned["series_id"] == "late"]["value"].tolist() == [0.0] + [1.0] * 5


def test_series_covariates(spark):
    frame = long_frame({"b": np.ones(3), "a": np.ones(2), "c": np.ones(1)})
    got = panel.series_covariates(to_spark(spark, frame), KEY).select("series_id", "series_index", "series_unit").distinct()
    rows = {r[0]: (r[1], round(r[2], 6)) for r in got.collect()}
    assert rows == {"a": (0, -0.5), "b": (1, round(1 / 3 - 0.5, 6)), "c": (2, round(2 / 3 - 0.5, 6))}


def pandas_features(frame: pd.DataFrame, cols: list[str]) -> pd.DataFrame:
    numeric = frame[cols]
    q1, q3 = numeric.quantile(0.25), numeric.quantile(0.75)
    outside = ((numeric < q1 - 1.5 * (q3 - q1)) | (numeric > q3 + 1.5 * (q3 - q1))).any(axis=1)
    out = frame[~outside].reset_index(drop=True).ffill().bfill()
    out["day_of_week"], out["day_of_month"] = out["ts"].dt.dayofweek * 1.0, out["ts"].dt.day * 1.0
    out["month"], out["hour"] = out["ts"].dt.month * 1.0, out["ts"].dt.hour * 1.0
    base = [*cols, "day_of_week", "day_of_month", "month", "hour"]
    train = out.loc[: int(len(out) * 0.7) - 1, base]
    width = (train.quantile(0.75) - train.quantile(0.25)).replace(0, 1)
    out[base] = (out[base] - train.quantile(0.5)) / width
    for c in base:
        out[f"{c}_lag1"] = out[c].shift(1)
        out[f"{c}_rolling_mean"] = out[c].rolling(5).mean()
        out[f"{c}_rolling_std"] = out[c].rolling(5).std()
    return out.ffill().bfill()


@pytest.mark.parametrize("chunk", [16, 4096])
def test_feature_matrix_matches_pandas(spark, chunk):
    rng = np.random.default_rng(8)
    frame = long_frame({"a": rng.normal(size=150)}).drop(columns="series_id")
    frame["other"] = rng.normal(size=150)
    frame.loc[[0, 1, 70, 149], "value"] = np.nan
    frame.loc[20, "other"] = 50.0
    got = collected(feature_matrix(to_spark(spark, frame), ["value", "other"], chunk=chunk), ["pos"])
    want = pandas_features(frame, ["value", "other"])
    assert len(got) == len(want)
    assert len(feature_names([f"c{i}" for i in range(7)])) == 44
    for c in feature_names(["value", "other"]):
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), want[c].to_numpy(), atol=1e-6, err_msg=c)


def test_plan_time_checks(spark):
    df = to_spark(spark, long_frame({"a": np.ones(2)}))
    with pytest.raises(ValueError, match="missing columns: nope"):
        filters.require_columns(df, ["value", "nope"])
    with pytest.raises(ValueError, match="context_length"):
        filters.require_columns(df, ["value"], context_length=0)
    with pytest.raises(TypeError, match="series_id"):
        filters.numeric_cast(df, ["series_id"])
