import math

import numpy as np
import pytest
from helpers import START

import pandas as pd
from pyspark.sql import functions as F

from tideloom.operators import evaluation

KEY = ["series_id"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_alignment_is_by_timestamp(spark):
    hours = [(START + pd.Timedelta(hours=h)).to_pydatetime() for h in range(4)]
    actual = frame(spark, [("a", hours[h], float(h)) for h in range(3)], "series_id string, ts timestamp_ntz, value double")
    forecast = frame(spark, [("a", hours[h], 10.0) for h in (1, 2, 3)], "series_id string, ts timestamp_ntz, yhat double")
    row = evaluation.mse_aligned(actual, forecast, KEY).first()
    assert row.n == 2 and row.mse == pytest.approx((81 + 64) / 2)
    assert evaluation.forecast_overlay(actual, forecast, KEY).count() == 4


def test_metrics_with_zero_actuals(spark):
    rows = [("a", 0.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 5.0), ("a", None, 5.0)]
    got = evaluation.metrics5(frame(spark, rows, "series_id string, value double, yhat double"), KEY).first()
    assert (got.mae, got.mse, got.rmse) == (1.0, 1.0, 1.0)
    assert got.mape == pytest.approx((0.5 + 0.25) / 2)
    assert got.mspe == pytest.approx((0.25 + 0.0625) / 2)
    assert (got.n, got.n_relative) == (3, 2)


def test_mined_share(spark):
    df = spark.range(6).select(evaluation.mined_share(F.col("id"), F.lit(33)).alias("k"))
    want = [33, 33, int(33 * 3 / 4), int(33 * 2 / 3), 16, 16]
    assert [r.k for r in df.collect()] == want


def test_hard_windows(spark):
    rows = [(e, b, w, float((w * 7 + e) % 11)) for e in (0, 2, 5) for b in (0, 1) for w in range(8)]
    log = frame(spark, rows, "epoch int, batch int, window_id int, loss double")
    got = evaluation.hard_windows_by_epoch(log).toPandas()
    for (e, b), part in got.groupby(["epoch", "batch"]):
        k = {0: 8, 2: 6, 5: 4}[e]
        losses = sorted([r[3] for r in rows if r[0] == e and r[1] == b], reverse=True)[:k]
        assert sorted(part["loss"], reverse=True) == losses


def test_gaussian_likelihood(spark):
    rows = [(0.0, 1.0, 2.0), (3.0, 1.0, 2.0), (-1.0, 0.0, 1.0)]
    df = frame(spark, rows, "label double, mu double, sigma double")
    got = {r.label: r.nll for r in evaluation.gaussian_nll(df).collect()}
    assert set(got) == {3.0, -1.0}
    density = math.exp(-((3 - 1) ** 2) / 8) / (2 * math.sqrt(2 * math.pi))
    assert got[3.0] == pytest.approx(-math.log(density))
    assert {r.label for r in evaluation.gaussian_nll(df, ignore_zero=False).collect()} == {0.0, 3.0}
    assert {r.ae for r in evaluation.masked_abs_error(df).collect()} == {2.0, 1.0}


def test_topk_each_ranks_columns_apart(spark):
    df = frame(spark, [(1, 5.0, 1.0), (2, 3.0, 9.0), (3, 4.0, 8.0)], "id int, nll double, se double")
    rows = {(r.measure, r["rank"]): r.value for r in evaluation.topk_each(df, ["nll", "se"], 2, ["id"]).collect()}
    assert rows == {("nll", 1): 5.0, ("nll", 2): 4.0, ("se", 1): 9.0, ("se", 2): 8.0}


def test_run_aggregates(spark):
    log = frame(spark, [("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 2.0)], "run string, epoch int, mse double")
    best = {r.run: r.epoch for r in evaluation.best_epoch(log, ["run"]).collect()}
    assert best == {"a": 2, "b": 1}
    mean = {r.run: r.mse for r in evaluation.repeat_mean(log, ["run"], ["mse"]).collect()}
    assert mean["a"] == pytest.approx(5 / 3)
    batches = frame(spark, [("a", 10.0, 2), ("a", 1.0, 8)], "run string, loss_sum double, n int")
    assert evaluation.pooled_loss(batches, ["run"]).first().loss == pytest.approx(1.1)


def test_complete_horizons_and_topk(spark):
    rows = [(w, s, float(w), 0.0) for w in range(5) for s in range(1, 4) if (w, s) != (2, 3)]
    df = frame(spark, rows, "window_id int, step int, value double, yhat double")
    kept = evaluation.complete_horizons(df, ["window_id"], 3)
    assert {r.window_id for r in kept.collect()} == {0, 1, 3, 4}
    top = evaluation.topk_window_mse(df, ["window_id"], 2).collect()
    assert [(r.window_id, r.loss) for r in top] == [(4, 16.0), (3, 9.0)]
    np.testing.assert_allclose([r.loss for r in top], [16.0, 9.0])
