import numpy as np
import pytest
from helpers import arma, long_frame, to_spark

from tideloom.models import backtest, selection
from tideloom.models.backtest import Arima, Autoregression, Repeat, Window

KEY = ["series_id"]
SHARES = (0.5, 0.65, 0.8)


def plain_path(candidate, x, horizon):
    """The candidate fitted to ``x`` by direct sums and least squares."""
    if isinstance(candidate, Repeat):
        return np.resize(x[-candidate.season :], horizon)
    if isinstance(candidate, Autoregression):
        p = candidate.p
        design = np.array([np.r_[x[t - p : t][::-1], 1.0] for t in range(p, len(x))])
        beta, *_ = np.linalg.lstsq(design, x[p:], rcond=None)
        known = list(x)
        for _ in range(horizon):
            known.append(beta[-1] + beta[:-1] @ known[: -p - 1 : -1])
        return np.array(known[len(x) :])
    if isinstance(candidate, Window):
        c, h = candidate.context, candidate.horizon
        starts = range(len(x) - c - h + 1)
        design = np.array([np.r_[x[s : s + c], 1.0] for s in starts])
        beta, *_ = np.linalg.lstsq(design, np.array([x[s + c : s + c + h] for s in starts]), rcond=None)
        return np.r_[x[-c:], 1.0] @ beta[:, :horizon]
    step = candidate.seasonal[3] if candidate.seasonal[1] else 1
    w = x[step:] - x[:-step]
    phi = w[1:] @ w[:-1] / (w[:-1] @ w[:-1])
    level = list(x)
    for h in range(1, horizon + 1):
        level.append(level[-step] + phi**h * w[-1])
    return np.array(level[len(x) :])


CANDIDATES = [Autoregression(1), Autoregression(3), Arima((1, 1, 0)), Arima((1, 0, 0), (0, 1, 0, 7)), Repeat(7), Window(5, 10, 0.0)]


@pytest.mark.parametrize("chunk", [40, None])
def test_every_fold_is_fitted_on_its_prefix(spark, chunk):
    series = {"a": arma(301, 0.6, seed=1) + 50, "b": np.cumsum(arma(150, 0.3, seed=2)) + 10 * np.sin(np.arange(150) * 2 * np.pi / 7)}
    rows = backtest.backtest(to_spark(spark, long_frame(series)), CANDIDATES, KEY, 10, SHARES, chunk=chunk).collect()
    assert len(rows) == 2 * len(CANDIDATES) * len(SHARES)
    got = {(r.series_id, r.model, r.fold): r for r in rows}
    for name, x in series.items():
        for fold, share in enumerate(SHARES):
            origin = int(len(x) * share)
            actual = x[origin : origin + 10]
            for candidate in CANDIDATES:
                row = got[name, candidate.name, fold]
                assert (row.origin, row.steps) == (origin, len(actual))
                want = ((plain_path(candidate, x[:origin], 10) - actual) ** 2).sum()
                assert row.squares == pytest.approx(want, rel=1e-6), (candidate, fold)


def test_short_missing_and_constant_series(spark):
    holed = arma(100, 0.5, seed=3)
    holed[20] = np.nan
    series = {"tiny": np.array([1.0, 2.0]), "one": np.array([4.0]), "flat": np.ones(60), "holed": holed, "good": arma(90, 0.5, seed=4)}
    folds = backtest.backtest(to_spark(spark, long_frame(series)), CANDIDATES, KEY, 10, SHARES)
    rows = folds.collect()
    by = {}
    for r in rows:
        by.setdefault(r.series_id, {}).setdefault(r.model, []).append(r.squares)
    assert all(v is None for m in by["holed"].values() for v in m) and "one" not in by
    assert by["flat"]["arima(1,1,0)"] == [None] * 3 and by["flat"]["repeat(7)"] == [0.0] * 3
    assert all(v is None for m in by["tiny"].values() for v in m)
    best = {r.series_id: r.model for r in selection.model_select(backtest.backtest_scores(folds, KEY), KEY).collect()}
    assert set(best) == {"flat", "good"}


def test_moving_average_terms_follow_the_cut_filter(spark):
    x = np.cumsum(arma(400, 0.4, 0.5, seed=5))
    got = backtest.backtest(to_spark(spark, long_frame({"a": x})), [Arima((1, 1, 1))], KEY, 5, (0.9,)).first()
    w, e = np.diff(x[:360]), np.zeros(359)
    assert got.squares > 0
    # At any nearby parameters the recursion's one-step errors are no smaller in sum.
    from tideloom.models.solve import ArmaShape, forecast_arma

    shape = ArmaShape((1, 0, 1))

    def squares(params):
        for t in range(len(w)):
            e[t] = w[t] - (params[0] * w[t - 1] + params[1] * e[t - 1] if t else 0)
        return float(e @ e)

    grid = [(squares((p, q)), p, q) for p in np.arange(0.2, 0.7, 0.02) for q in np.arange(0.2, 0.8, 0.02)]
    _, p, q = min(grid)
    path = x[359] + np.cumsum(forecast_arma(w, shape.filter(np.array([p, q]), 48), 5))
    assert got.squares == pytest.approx(((path - x[360:365]) ** 2).sum(), rel=0.1)
