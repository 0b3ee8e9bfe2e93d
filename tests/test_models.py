import math

import numpy as np
import pandas as pd
import pytest
from helpers import arma, collected, long_frame, to_spark
from pyspark.sql import functions as F

from tideloom.functions.times import HOUR
from tideloom.models import arima, diagnostics, linear, selection
from tideloom.models.moments import SeriesMoments, lag_moments
from tideloom.models.solve import ArmaShape, inverse_series, is_stable
from tideloom.operators.windows import cut_windows

KEY = ["series_id"]


def moments_of(spark, frame, cols, max_lag, chunk=None):
    rows = lag_moments(to_spark(spark, frame), cols, KEY, max_lag, chunk=chunk).collect()
    return {r.series_id: SeriesMoments(r.n, r.sums, r.moments, r.head, r.tail) for r in rows}


@pytest.mark.parametrize("chunk", [6, 40, None])
def test_moments_match_brute_force(spark, chunk):
    rng = np.random.default_rng(0)
    series = {"long": rng.normal(size=130), "mid": rng.normal(size=12), "tiny": rng.normal(size=3)}
    frame = long_frame(series)
    frame["x"] = rng.normal(size=len(frame))
    found = moments_of(spark, frame, ["value", "x"], 9, chunk)
    for name, part in frame.groupby("series_id"):
        values = part[["value", "x"]].to_numpy().T
        n = values.shape[1]
        for low, high, lags_a, lags_b in (
            (0, n - 1, range(0, 6), range(0, 8)),
            (5, n - 1, range(-1, 5), range(0, 5)),
            (4, n - 4, range(-3, 4), range(-3, 5)),
        ):
            for a in (0, 1):
                for b in (0, 1):
                    got = found[name].block(a, b, lags_a, lags_b, low, high)
                    want = np.zeros_like(got)
                    for i in lags_a:
                        for j in lags_b:
                            for t in range(low, high + 1):
                                if 0 <= t - i < n and 0 <= t - j < n:
                                    want[i - lags_a.start, j - lags_b.start] += values[a, t - i] * values[b, t - j]
                    np.testing.assert_allclose(got, want, atol=1e-9)
        assert found[name].total(1, 1, n - 2) == pytest.approx(values[1, 1 : n - 1].sum())


def direct_adf(x, max_lag):
    """The test by plain least squares, lag count by AIC on the common sample."""
    change = np.diff(x)

    def regress(k, start):
        rows = range(start, len(change))
        y = np.array([change[t] for t in rows])
        design = np.array([[x[t], *[change[t - i] for i in range(1, k + 1)], 1.0] for t in rows])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        rss = float(((y - design @ beta) ** 2).sum())
        cov = rss / (len(y) - design.shape[1]) * np.linalg.inv(design.T @ design)
        aic = len(y) * (math.log(2 * math.pi * rss / len(y)) + 1) + 2 * design.shape[1]
        return beta[0] / math.sqrt(cov[0, 0]), aic

    lags = min((regress(k, max_lag)[1], k) for k in range(max_lag + 1))[1]
    return regress(lags, lags)[0], lags


def test_stationarity_matches_least_squares(spark):
    walk = np.cumsum(np.random.default_rng(5).normal(size=400))
    series = {"ar": arma(500, 0.6, seed=1) + 30, "walk": walk, "ma": arma(300, 0.0, 0.7, seed=2), "flat": np.ones(40)}
    rows = diagnostics.stationarity_test(to_spark(spark, long_frame(series)), KEY, max_lag=8, chunk=64).collect()
    got = {r.series_id: r for r in rows}
    for name in ("ar", "walk", "ma"):
        stat, lags = direct_adf(series[name], 8)
        assert got[name].adf_stat == pytest.approx(stat, rel=1e-6)
        assert got[name].adf_lags == lags
    assert got["ar"].stationary and got["ma"].stationary and not got["walk"].stationary
    assert got["flat"].stationary is False and got["flat"].adf_stat is None
    assert got["walk"].p_value > 0.05 > got["ar"].p_value


def test_dickey_fuller_is_the_test_without_lags(spark):
    x = arma(200, 0.8, seed=3)
    row = diagnostics.dickey_fuller(to_spark(spark, long_frame({"a": x})), KEY, chunk=32).first()
    assert row.df_stat == pytest.approx(direct_adf(x, 0)[0], rel=1e-8)


@pytest.mark.parametrize("period,chunk", [(24, 50), (7, 1000)])
def test_decomposition_adds_up(spark, period, chunk):
    n = period * 8 + 3
    t = np.arange(n)
    season = np.sin(2 * np.pi * t / period)
    x = 0.05 * t + season
    got = collected(diagnostics.seasonal_decompose(to_spark(spark, long_frame({"a": x})), KEY, period, chunk=chunk))
    half = period // 2
    kernel = np.r_[0.5, np.ones(period - 1), 0.5] / period if period % 2 == 0 else np.ones(period) / period
    np.testing.assert_allclose(got["trend"][half : n - half], np.convolve(x, kernel, "valid"), atol=1e-9)
    assert got["trend"].isna().sum() == 2 * half
    inner = got.dropna()
    np.testing.assert_allclose(inner["trend"] + inner["seasonal"] + inner["resid"], inner["value"])
    np.testing.assert_allclose(got["seasonal"], season - season[:period].mean(), atol=1e-6)


def test_power_series_and_stability():
    poly = np.zeros(20)
    poly[[0, 1, 4]] = 1.0, 0.5, -0.3
    np.testing.assert_allclose(np.convolve(poly, inverse_series(poly))[:20], np.eye(1, 20)[0], atol=1e-12)
    assert is_stable(np.array([0.5, 0.3]), -1) and not is_stable(np.array([0.5, 0.6]), -1)


def test_filter_slopes_match_differences():
    shape = ArmaShape((2, 0, 1), (1, 0, 1, 4), regressors=1)
    params = np.array([0.7, 0.4, -0.2, 0.3, 0.5, -0.4])
    taps, slopes = shape.filter_and_slopes(params, 30)
    for k in range(5):
        step = np.zeros(6)
        step[1 + k] = 1e-6
        np.testing.assert_allclose((shape.filter(params + step, 30) - taps) / 1e-6, slopes[k], atol=1e-4)


def brute_css(x, order, params):
    """Residual recursion with zero pre-sample values."""
    p, _, q = order
    e = np.zeros(len(x))
    for t in range(len(x)):
        ar = sum(params[k] * x[t - 1 - k] for k in range(p) if t - 1 - k >= 0)
        ma = sum(params[p + k] * e[t - 1 - k] for k in range(q) if t - 1 - k >= 0)
        e[t] = x[t] - ar - ma
    return e


def test_arma_recovery_and_sum_of_squares(spark):
    series = {"arma": arma(4000, 0.6, 0.3, seed=7), "ar": arma(4000, -0.5, seed=8), "ma": arma(4000, 0.0, 0.5, seed=9)}
    df = to_spark(spark, long_frame(series))
    rows = arima.fit_orders(df, KEY, [((1, 0, 1), arima.NO_SEASON)], "arima", constant=True).collect()
    got = {r.series_id: r for r in rows}
    np.testing.assert_allclose(got["arma"].params, [0.6, 0.3], atol=0.06)
    assert got["ar"].status == got["ma"].status == "ok"
    x = series["arma"] - series["arma"].mean()
    e = brute_css(x, (1, 0, 1), got["arma"].params)
    assert got["arma"].sigma2 == pytest.approx((e**2).mean(), rel=1e-9)
    for bump in ((1e-3, 0), (0, 1e-3), (-1e-3, 0), (0, -1e-3)):
        moved = np.array(got["arma"].params) + bump
        assert (brute_css(x, (1, 0, 1), moved) ** 2).sum() >= (e**2).sum()


def test_fit_does_not_depend_on_chunks(spark):
    frame = long_frame({"a": arma(900, 0.5, 0.4, seed=1)})
    fits = [
        arima.fit_orders(to_spark(spark, frame, parts), KEY, [((1, 0, 1), arima.NO_SEASON)], "arima", lags=40, chunk=chunk).first()
        for parts, chunk in ((1, None), (4, 64), (16, 333))
    ]
    for fit in fits[1:]:
        np.testing.assert_allclose(fit.params, fits[0].params, atol=1e-7)
        assert fit.aic == pytest.approx(fits[0].aic, abs=1e-6)


def test_gate_and_failures(spark):
    walk = np.cumsum(np.random.default_rng(5).normal(size=400))
    series = {"walk": walk, "ok": arma(400, 0.5, seed=1), "flat": np.ones(50), "tiny": np.array([1.0, 2.0, 1.0])}
    df = to_spark(spark, long_frame(series))
    rows = {r.series_id: r for r in arima.arima_fit(df, KEY, (1, 1, 1), adf_lags=8).collect()}
    assert len(rows) == 4
    assert rows["walk"].status == "non-stationary" and rows["walk"].params is None
    assert rows["ok"].status == "ok"
    ungated = {r.series_id: r for r in arima.arima_fit(df, KEY, (1, 1, 1), gate=False).collect()}
    assert ungated["walk"].status == "ok"
    assert ungated["flat"].status.startswith("failed") and ungated["tiny"].status.startswith("failed")


def seasonal_series(n=3000, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    noise = rng.normal(size=n)
    u = np.zeros(n)
    # (1 - 0.5B)(1 - 0.4B^24) u = (1 + 0.3B) noise
    for t in range(n):
        u[t] = noise[t]
        u[t] += 0.3 * noise[t - 1] + 0.5 * u[t - 1] if t >= 1 else 0
        u[t] += 0.4 * u[t - 24] if t >= 24 else 0
        u[t] -= 0.2 * u[t - 25] if t >= 25 else 0
    return np.cumsum(u + 1.5 * np.diff(np.r_[0, x])), x


def test_sarimax_recovery_grid_and_choice(spark):
    y, x = seasonal_series()
    frame = long_frame({"a": y})
    frame["x"] = x
    df = to_spark(spark, frame)
    models = arima.sarimax_grid_fit(
        df, KEY, ((1, 1, 1), (0, 1, 0)), ((1, 0, 0, 24), (0, 0, 0, 24)), exog=["x"]
    )
    rows = models.collect()
    assert len(rows) == 4 and {r.status for r in rows} == {"ok"}
    best = selection.best_by_aic(models, KEY).first()
    assert best.order == [1, 1, 1, 1, 0, 0, 24]
    np.testing.assert_allclose(best.params, [1.5, 0.5, 0.3, 0.4], atol=0.08)


def test_forecast_follows_the_recursion(spark):
    series = {"a": arma(300, 0.7, 0.2, seed=4) + 10}
    frame = long_frame(series)
    df = to_spark(spark, frame)
    for order in ((1, 0, 1), (1, 1, 1)):
        models = arima.arima_fit(df, KEY, order, gate=False, lags=400)
        model = models.first()
        got = collected(arima.arima_forecast(df, models, KEY, 6, lags=400), ["step"])
        x = series["a"] - model.mean if order[1] == 0 else np.diff(series["a"])
        e = brute_css(x, order, model.params)
        path, value, error = [], x[-1], e[-1]
        for _ in range(6):
            value, error = model.params[0] * value + model.params[1] * error, 0.0
            path.append(value)
        path = np.array(path) + model.mean if order[1] == 0 else series["a"][-1] + np.cumsum(path)
        np.testing.assert_allclose(got["yhat"], path, rtol=1e-9)
        assert got["ts"].tolist() == pd.date_range(frame["ts"].max(), periods=7, freq="h")[1:].tolist()


def test_forecast_reads_what_its_order_needs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=1500)
    df = to_spark(spark, long_frame({"a": x}))
    models = arima.sarimax_grid_fit(df, KEY, ((0, 0, 0),), ((1, 1, 0, 168),))
    got = collected(arima.sarimax_forecast(df, models, KEY, 5), ["step"])
    ahead = x[-168:-163] + models.first().params[0] * (x[-168:-163] - x[-336:-331])
    np.testing.assert_allclose(got["yhat"], ahead, atol=1e-9)
    slow = arima.arima_fit(df, KEY, (0, 0, 1), gate=False).withColumn("params", F.array(F.lit(-0.98)))
    model = slow.first()
    got = collected(arima.arima_forecast(df, slow, KEY, 2), ["step"])
    error = brute_css(x - model.mean, (0, 0, 1), model.params)[-1]
    np.testing.assert_allclose(got["yhat"], [model.mean - 0.98 * error, model.mean], atol=1e-6)


def test_lags_of_the_stationarity_test_grow_with_the_series(spark):
    x = np.random.default_rng(6).normal(size=2000)
    for t in range(26, len(x)):
        x[t] += 0.7 * x[t - 26]
    row = diagnostics.stationarity_test(to_spark(spark, long_frame({"a": x})), KEY).first()
    assert 20 < row.adf_lags <= 26
    assert diagnostics.stationarity_test(to_spark(spark, long_frame({"a": x})), KEY, 20).first().adf_lags <= 20


def test_sarimax_forecast_with_regressors(spark):
    n, period = 480, 24
    t = np.arange(n)
    rng = np.random.default_rng(2)
    x = rng.normal(size=n)
    y = 3 * np.sin(2 * np.pi * t / period) + 2 * x + 0.01 * rng.normal(size=n)
    frame = long_frame({"a": y})
    frame["x"] = x
    df = to_spark(spark, frame)
    models = arima.sarimax_grid_fit(df, KEY, ((0, 0, 0),), ((0, 1, 0, 24),), exog=["x"])
    season = 3 * np.sin(2 * np.pi * np.arange(n, n + 10) / period)
    reused = collected(arima.sarimax_forecast(df, models, KEY, 10, exog=["x"]), ["step"])
    np.testing.assert_allclose(reused["yhat"], season + 2 * x[-10:], atol=0.15)
    future = spark.createDataFrame([("a", s + 1, float(s)) for s in range(10)], "series_id string, step int, x double")
    given = collected(arima.sarimax_forecast(df, models, KEY, 10, exog=["x"], future=future), ["step"])
    np.testing.assert_allclose(given["yhat"], season + 2 * np.arange(10.0), atol=0.15)


def test_seasonal_and_double_differencing(spark):
    t = np.arange(200.0)
    y = 0.5 * t + 0.02 * t**2 + 5 * (t % 7)
    frame = long_frame({"a": y})
    weights = arima.difference_weights(1, 1, 7)
    assert weights == {0: 1, 1: -1, 7: -1, 8: 1}
    got = collected(arima.differenced(to_spark(spark, frame), ["value"], KEY, 1, 1, 7, chunk=16))
    np.testing.assert_allclose(got["value"], np.diff(y[7:] - y[:-7]), atol=1e-9)
    from tideloom.models.solve import difference, integrate

    changes = difference(y[:150], 2, 1, 7)
    future = difference(y, 2, 1, 7)[len(changes) :]
    np.testing.assert_allclose(integrate(y[:150], future, 2, 1, 7), y[150:], atol=1e-6)


def test_ar_fit_matches_least_squares(spark):
    x = arma(700, 0.6, seed=2) + 5
    df = to_spark(spark, long_frame({"a": x}))
    row = arima.ar_fit(df, KEY, 3, chunk=64).first()
    design = np.column_stack([x[2:-1], x[1:-2], x[:-3], np.ones(len(x) - 3)])
    beta, *_ = np.linalg.lstsq(design, x[3:], rcond=None)
    np.testing.assert_allclose([*row.coefs, row.intercept], beta, rtol=1e-6)
    one = arima.ar1_fit(df, KEY, chunk=64).first()
    slope, level = np.polyfit(x[:-1], x[1:], 1)
    assert (one.phi, one.intercept) == (pytest.approx(slope), pytest.approx(level))


def test_ar1_forecast_closed_form(spark):
    frame = long_frame({"a": arma(50, 0.5, seed=2)})
    df = to_spark(spark, frame)
    models = spark.createDataFrame([("a", 0.5, 2.0, 3)], "series_id string, phi double, intercept double, h int")
    got = collected(arima.ar1_forecast(df, models, KEY, "h"), ["step"])
    y, want = frame["value"].iloc[-1], []
    for _ in range(3):
        y = 2.0 + 0.5 * y
        want.append(y)
    np.testing.assert_allclose(got["yhat"], want)
    unit = models.withColumn("phi", F.lit(1.0))
    np.testing.assert_allclose(
        collected(arima.ar1_forecast(df, unit, KEY, 2, HOUR), ["step"])["yhat"], frame["value"].iloc[-1] + np.array([2.0, 4.0])
    )


@pytest.mark.parametrize("features", [[], ["x"]])
def test_window_linear_matches_least_squares(spark, features):
    rng = np.random.default_rng(6)
    frame = long_frame({"a": arma(400, 0.5, seed=3), "tiny": np.arange(6.0)})
    frame["x"] = rng.normal(size=len(frame))
    df = to_spark(spark, frame)
    context, horizon, cols = 5, 3, ["value", *features]
    models = linear.window_linear_fit(df, KEY, context, horizon, features=features, penalty=0.0, chunk=64)
    rows = {r.series_id: r for r in models.collect()}
    assert rows["tiny"].coefs is None
    part = frame[frame["series_id"] == "a"]
    values = part[cols].to_numpy()
    starts = range(400 - context - horizon + 1)
    design = np.array([np.r_[values[s : s + context].T.ravel(), 1.0] for s in starts])
    future = np.array([values[s + context : s + context + horizon, 0] for s in starts])
    beta, *_ = np.linalg.lstsq(design, future, rcond=None)
    np.testing.assert_allclose(np.array(rows["a"].coefs), beta[:-1].T, atol=1e-8)
    np.testing.assert_allclose(rows["a"].intercepts, beta[-1], atol=1e-8)
    windows = cut_windows(df, cols, KEY, context, horizon, stride=50)
    got = collected(linear.window_linear_predict(windows, models, KEY, cols), ["window_id", "step"])
    picked = [s for s in starts if s % 50 == 0]
    np.testing.assert_allclose(got["yhat"], (design[picked] @ beta).ravel(), atol=1e-8)
    np.testing.assert_allclose(got["value"], future[picked].ravel())
    ahead = collected(linear.window_linear_forecast(df, models, KEY, context, cols), ["step"])
    np.testing.assert_allclose(ahead["yhat"], np.r_[values[-context:].T.ravel(), 1.0] @ beta, atol=1e-8)
    assert ahead["ts"].tolist() == pd.date_range(part["ts"].max(), periods=4, freq="h")[1:].tolist()


def test_window_linear_of_five_channels_with_marks(spark):
    rng = np.random.default_rng(12)
    n, context, horizon = 260, 4, 3
    names = ["c1", "c2", "c3", "c4", "c5"]
    values = rng.normal(size=(n, 5)).cumsum(axis=0) * 0.1 + rng.normal(size=(n, 5))
    angle = 2 * np.pi * np.arange(n) / 24
    frame = pd.DataFrame(values, columns=names)
    frame["sin"], frame["cos"] = np.sin(angle), np.cos(angle)
    frame = pd.concat([pd.DataFrame({"series_id": "a", "pos": np.arange(n)}), frame], axis=1)
    tiny = frame.head(3).assign(series_id="tiny")
    df = to_spark(spark, pd.concat([frame, tiny]))
    models = linear.window_linear_fit(df, KEY, context, horizon, target=names, penalty=0.0, chunk=50, marks=["sin", "cos"])
    rows = {r.series_id: r for r in models.collect()}
    assert rows["tiny"].coefs is None and rows["tiny"].status == "failed: too few rows" and rows["a"].status == "ok"
    marks = np.column_stack([np.sin(angle), np.cos(angle)])
    starts = range(n - context - horizon + 1)
    design = np.array(
        [np.r_[values[s : s + context].T.ravel(), marks[s + context : s + context + horizon].T.ravel(), 1.0] for s in starts]
    )
    future = np.array([values[s + context : s + context + horizon].T.ravel() for s in starts])
    beta, *_ = np.linalg.lstsq(design, future, rcond=None)
    np.testing.assert_allclose(np.array(rows["a"].coefs), beta[:-1].T, atol=1e-7)
    np.testing.assert_allclose(rows["a"].intercepts, beta[-1], atol=1e-7)
    windows = cut_windows(df, [*names, "sin", "cos"], KEY, context, horizon, stride=40)
    got = linear.window_linear_predict(windows, models, KEY, names, names, ["sin", "cos"]).toPandas()
    got = got.sort_values(["window_id", "channel", "step"])
    picked = [s for s in starts if s % 40 == 0]
    np.testing.assert_allclose(got["yhat"], (design[picked] @ beta).ravel(), atol=1e-7)
    np.testing.assert_allclose(got["value"], future[picked].ravel())
    short = cut_windows(df.where("series_id = 'tiny'"), names, KEY, 2, 1)
    assert linear.window_linear_predict(short, models, KEY, names, names).count() == 0
    failed = linear.window_linear_predict(short, models, KEY, names, names, keep_failed=True).collect()
    assert [(r.series_id, r.step, r.yhat, r.status) for r in failed] == [("tiny", None, None, "failed: too few rows")]


def test_requests_are_routed(spark):
    series = spark.createDataFrame([("a",), ("b",)], "series_id string")
    models = spark.createDataFrame([("a", "ar1")], "series_id string, model string")
    forecasts = spark.createDataFrame([("a", "ar1", 1, None, 7.0)], "series_id string, model string, step int, ts timestamp_ntz, yhat double")
    asked = [(1, "a", "ar1", 1), (2, "a", "ar1", 9), (3, "a", "other", 1), (4, "z", "ar1", 1), (5, "b", "ar1", 1)]
    requests = spark.createDataFrame(asked, "request_id int, series_id string, model string, horizon int")
    rows = {r.request_id: r for r in selection.forecast_requests(requests, series, models, forecasts).collect()}
    assert rows[1].status == "result" and rows[1].yhat == 7.0
    assert rows[2].error == "no forecast at this horizon"
    assert rows[3].error == rows[5].error == "no such model"
    assert rows[4].error == "unknown series"


def test_missing_value_fails_its_own_series_only(spark):
    series = {"whole": arma(400, 0.5, seed=5), "holed": arma(400, 0.5, seed=6)}
    frame = long_frame(series)
    frame.loc[frame.index[(frame.series_id == "holed")][100], "value"] = None
    rows = to_spark(spark, frame)
    tested = {r.series_id: r.stationary for r in diagnostics.stationarity_test(rows, KEY, 4).collect()}
    assert tested == {"whole": True, "holed": None}
    for gate in (True, False):
        fits = {r.series_id: r.status for r in arima.arima_fit(rows, KEY, (1, 0, 0), adf_lags=4, gate=gate).collect()}
        assert fits == {"whole": "ok", "holed": "failed: missing values"}
