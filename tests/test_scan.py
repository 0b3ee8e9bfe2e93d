import numpy as np
import pytest
from helpers import arma, collected, long_frame, to_spark
from pyspark.sql import functions as F

from tideloom.models import arima, scan, selection
from tideloom.models.scan import Model, recur

KEY = ["series_id"]


def plain(levels, code, params, mean=0.0):
    """Residuals of the whole series by the recursion, one row at a time; 0 in rows lost to differencing."""
    model = Model.of(code, params, mean, len(levels) - 1)
    ar, ma, *_ = model.factors()
    w = np.array([np.convolve(x, model.differences())[: len(x)] for x in levels])
    w[:, : model.reach] = 0.0
    w[0, model.reach :] -= mean
    n = w[0] - model.params[: len(levels) - 1] @ w[1:]
    e = np.zeros(len(n))
    for t in range(len(n)):
        e[t] = sum(a * n[t - i] for i, a in enumerate(ar) if a and i <= t) - sum(b * e[t - j] for j, b in enumerate(ma) if b and 0 < j <= t)
    return e


def minimum(f, start, step=1e-4):
    """Newton's method on central differences."""
    x, k = np.array(start, dtype=float), len(start)
    unit = np.eye(k) * step
    for _ in range(4):
        slope = np.array([f(x + u) - f(x - u) for u in unit]) / (2 * step)
        bend = np.array([[f(x + u + v) - f(x + u - v) - f(x - u + v) + f(x - u - v) for u in unit] for v in unit]) / (4 * step * step)
        x = x - np.linalg.solve(bend, slope)
    return x


CODES = [(1, 0, 1, 0, 0, 0, 1), (2, 1, 1, 0, 0, 0, 1), (1, 0, 1, 1, 0, 1, 4), (0, 1, 2, 0, 1, 1, 4), (2, 0, 0, 0, 0, 0, 1)]


@pytest.mark.parametrize("code", CODES)
def test_a_run_is_the_recursion_and_its_slopes(code):
    rng = np.random.default_rng(1)
    levels = np.array([rng.normal(size=70).cumsum(), rng.normal(size=70)])
    size = 1 + code[0] + code[2] + code[3] + code[5]
    params = np.r_[0.7, np.linspace(0.3, -0.4, size - 1)]
    model = Model.of(code, params, 0.2, 1)
    empty = np.zeros((model.carried, 1 + size))
    run = model.run(levels, 0, 0, empty)
    np.testing.assert_allclose(run[:, 0], plain(levels, code, params, 0.2), atol=1e-10)
    for k in range(size):
        up, down = params.copy(), params.copy()
        up[k], down[k] = up[k] + 1e-6, down[k] - 1e-6
        slope = (plain(levels, code, up, 0.2) - plain(levels, code, down, 0.2)) / 2e-6
        np.testing.assert_allclose(run[:, 1 + k], slope, atol=1e-6)
    # Cut anywhere, with the state carried over, the run is the same; the map predicts the state.
    cut, halo = 41, model.halo
    first = model.run(levels[:, :cut], 0, 0, empty)
    state = scan.last_rows(empty, first)
    rest = model.run(levels[:, cut - halo :], cut - halo, halo, state)
    np.testing.assert_allclose(np.vstack([first, rest]), run, atol=1e-9)
    alone = scan.last_rows(empty, model.run(levels[:, cut - halo :], cut - halo, halo, empty))
    moved = np.linalg.matrix_power(model.step(), 70 - cut) @ state.ravel() + alone.ravel()
    np.testing.assert_allclose(moved, scan.last_rows(state, rest).ravel(), atol=1e-9)


def test_recursion_in_steps_is_the_recursion():
    rng = np.random.default_rng(2)
    ma, x = np.array([1.0, -0.5, 0.0, 0.9]), rng.normal(size=(700, 2))
    past = rng.normal(size=(3, 2))
    out = list(past)
    for row in x:
        out.append(row - 0.9 * out[-3] + 0.5 * out[-1])
    np.testing.assert_allclose(recur(ma, x, past), out[3:], atol=1e-9)


@pytest.mark.parametrize("chunk", [300, 100_000])
def test_moving_average_near_one_is_fitted_exactly(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "BLOCK", 3)
    y = np.cumsum(arma(3000, 0.4, -0.99, seed=3))
    df = to_spark(spark, long_frame({"a": y, "b": np.cumsum(arma(500, 0.2, 0.5, seed=4))}))
    rows = {r.series_id: r for r in arima.arima_fit(df, KEY, (1, 1, 1), gate=False, chunk=chunk).collect()}
    got, code = rows["a"], (1, 1, 1, 0, 0, 0, 1)
    assert got.status == "ok" and got.params[1] < -0.97
    squares = lambda p: float((plain(y[None], code, p) ** 2).sum())
    np.testing.assert_allclose(got.params, minimum(squares, got.params), atol=1e-6)
    sigma2 = squares(got.params) / 2999
    assert got.sigma2 == pytest.approx(sigma2, rel=1e-10)
    assert got.aic == pytest.approx(2999 * (np.log(2 * np.pi * sigma2) + 1) + 6, rel=1e-10)
    np.testing.assert_allclose(got.residuals, plain(y[None], code, got.params)[-1:], atol=1e-9)


def test_the_search_for_a_start_has_no_part_in_the_result(spark):
    y = np.cumsum(arma(1500, 0.3, -0.97, seed=5))
    df = to_spark(spark, long_frame({"a": y}))
    fits = [
        arima.arima_fit(df, KEY, (1, 1, 1), gate=False, lags=lags, chunk=chunk).first()
        for lags, chunk in ((20, 400), (128, 5000), (400, 250))
    ]
    for fit in fits[1:]:
        np.testing.assert_allclose(fit.params, fits[0].params, atol=1e-7)
        assert fit.aic == pytest.approx(fits[0].aic, abs=1e-8)


def test_season_with_regressor_over_chunks(spark):
    rng = np.random.default_rng(6)
    n, x = 900, rng.normal(size=900)
    y = 2 * x + np.convolve(rng.normal(size=n + 7), [1, 0.4, 0, 0, 0, 0, 0, 0.5])[7 : n + 7] * 0.1
    frame = long_frame({"a": y})
    frame["x"] = x
    models = arima.sarimax_grid_fit(to_spark(spark, frame), KEY, ((1, 0, 1),), ((0, 0, 1, 7),), exog=["x"], chunk=128)
    got, code = models.first(), (1, 0, 1, 0, 0, 1, 7)
    levels = np.array([y, x])
    squares = lambda p: float((plain(levels, code, p) ** 2).sum())
    assert got.status == "ok"
    np.testing.assert_allclose(got.params, minimum(squares, got.params), atol=1e-6)
    np.testing.assert_allclose(got.residuals, plain(levels, code, got.params)[-8:], atol=1e-9)
    np.testing.assert_allclose(got.tail, levels[:, -1:], atol=0)


def test_a_root_on_the_edge_does_not_stop_the_others(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=600)
    y = 2 * x + 1.02 ** np.arange(600) + rng.normal(size=600)
    frame = long_frame({"a": y})
    frame["x"] = x
    got = arima.sarimax_grid_fit(to_spark(spark, frame), KEY, ((1, 0, 0),), (arima.NO_SEASON,), exog=["x"]).first()
    levels, code = np.array([y, x]), (1, 0, 0, 0, 0, 0, 1)
    assert got.status == "ok" and 0.99 < got.params[1] < 1
    squares = lambda p: float((plain(levels, code, [p[0], got.params[1]]) ** 2).sum())
    np.testing.assert_allclose(got.params[:1], minimum(squares, got.params[:1]), atol=1e-5)


def test_orders_of_any_differencing_compare_on_one_sample(spark):
    series = {"walk": np.cumsum(arma(400, 0.3, seed=7)), "level": 5 + arma(400, 0.5, seed=8), "tiny": np.arange(4.0)}
    df = to_spark(spark, long_frame(series))
    orders = [((1, 0, 0), arima.NO_SEASON), ((1, 1, 0), arima.NO_SEASON), ((0, 0, 0), (0, 1, 0, 24))]
    models = arima.fit_orders(df, KEY, orders, "arima", constant=True, chunk=150)
    rows = {(r.series_id, tuple(r.order)): r for r in models.collect()}
    for (name, code), row in rows.items():
        if row.status != "ok":
            assert name == "tiny"
            continue
        e = plain(series[name][None], code, row.params, row.mean)[24:]
        if not len(e):
            assert row.aic is None
            continue
        aic = len(e) * (np.log(2 * np.pi * (e @ e) / len(e)) + 1) + 2 * (len(row.params) + 1)
        assert row.aic == pytest.approx(aic, rel=1e-9)
    best = {r.series_id: r.order[1] for r in selection.best_by_aic(models, KEY).collect()}
    assert best == {"walk": 1, "level": 0}


def test_forecast_needs_the_model_row_only(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=1200).cumsum()
    df = to_spark(spark, long_frame({"a": x}))
    models = arima.sarimax_grid_fit(df, KEY, ((1, 0, 1),), ((0, 1, 1, 168),), chunk=200)
    model = models.first()
    got = collected(arima.forecast_stored(models, KEY, 200), ["step"])
    e = plain(x[None], model.order, model.params)
    m = Model.of(model.order, model.params, 0.0, 0)
    ar, ma, *_ = m.factors()
    w, e = list(x[168:] - x[:-168]), list(e)
    level = list(x)
    for _ in range(200):
        w.append(sum(-a * w[-i] for i, a in enumerate(ar) if i and a) + sum(b * e[-j] for j, b in enumerate(ma) if j and b))
        e.append(0.0)
        level.append(w[-1] + level[-168])
    np.testing.assert_allclose(got["yhat"], level[1200:], rtol=1e-8)
    assert len(model.residuals) == 169 and len(model.tail[0]) == 169
    # Brought to the end of the same rows, the stored models say the same.
    again = arima.end_states(df, models, KEY, chunk=300)
    np.testing.assert_allclose(collected(arima.forecast_stored(again, KEY, 9), ["step"])["yhat"], got["yhat"][:9], rtol=1e-9)


def test_models_go_on_with_new_rows(spark):
    y = np.cumsum(arma(700, 0.5, -0.6, seed=10))
    frame = long_frame({"a": y})
    old = arima.arima_fit(to_spark(spark, frame[:500]), KEY, (1, 1, 1), gate=False)
    state = arima.end_states(to_spark(spark, frame), old, KEY, chunk=90).first()
    np.testing.assert_allclose(state.residuals, plain(y[None], (1, 1, 1, 0, 0, 0, 1), old.first().params)[-1:], atol=1e-9)
    assert state.last == frame["ts"].max() and state.params == old.first().params


def test_short_future_gives_null_steps_and_every_series_a_path(spark):
    rng = np.random.default_rng(11)
    frame = long_frame({"a": rng.normal(size=60), "b": rng.normal(size=60)})
    frame["x"] = rng.normal(size=120)
    df = to_spark(spark, frame)
    models = arima.sarimax_grid_fit(df, KEY, ((1, 0, 0),), (arima.NO_SEASON,), exog=["x"])
    future = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 4, 1.0)], "series_id string, step int, x double")
    got = collected(arima.forecast_stored(models, KEY, 5, ["x"], future), ["series_id", "step"])
    assert got.groupby("series_id").size().to_dict() == {"a": 5, "b": 5}
    assert got["yhat"].notna().tolist() == [True, True, False, False, False] + [False] * 5
    with pytest.raises(ValueError):
        arima.forecast_stored(models, KEY, 5, ["x"])


def test_horizon_by_model(spark):
    df = to_spark(spark, long_frame({"a": arma(100, 0.5, seed=1), "b": arma(100, 0.5, seed=2)}))
    models = arima.arima_fit(df, KEY, (1, 0, 0), gate=False).withColumn("h", F.when(F.col("series_id") == "a", 3).otherwise(7))
    assert {r.series_id: r["count"] for r in arima.forecast_stored(models, KEY, "h").groupBy("series_id").count().collect()} == {"a": 3, "b": 7}
