"""The small per-series solves. Inputs are moment tables, so their size does not depend on
the length of a series."""

from __future__ import annotations

import numpy as np

from tideloom.models.moments import SeriesMoments


def ridge(gram: np.ndarray, cross: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """Least squares coefficients from ``X'X`` and ``X'Y``."""
    size = gram.shape[0]
    level = np.trace(gram) / max(size, 1)
    return np.linalg.lstsq(gram + penalty * level * np.eye(size), cross, rcond=None)[0]


def lag_polynomial(coefs: np.ndarray, sign: float, season: int, length: int) -> np.ndarray:
    """``1 + sign * (c1 B^s + c2 B^2s + …)`` as an array of ``length + 1`` coefficients."""
    out = np.zeros(length + 1)
    out[0] = 1.0
    for k, c in enumerate(coefs, start=1):
        if k * season <= length:
            out[k * season] = sign * c
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.convolve(a, b)[: len(a)]


def product_of(length: int, *factors: np.ndarray | None) -> np.ndarray:
    """Product of power series up to ``length``; ``None`` stands for 1."""
    present = [f for f in factors if f is not None]
    out = present[0] if present else np.eye(1, length + 1)[0]
    for factor in present[1:]:
        out = times(out, factor)
    return out


def inverse_series(poly: np.ndarray) -> np.ndarray:
    """Power series of ``1 / poly`` (leading coefficient 1), doubling the known terms."""
    lags = np.flatnonzero(poly[1:]) + 1
    if len(lags) <= 1:
        # One term: a geometric series.
        series = np.zeros(len(poly))
        step = int(lags[0]) if len(lags) else len(poly)
        count = len(series[::step])
        series[::step] = np.cumprod(np.concatenate([[1.0], np.full(count - 1, -poly[step] if len(lags) else 0.0)]))
        return series
    out = np.ones(1)
    while len(out) < len(poly):
        size = min(2 * len(out), len(poly))
        known = np.zeros(size)
        known[: len(out)] = out
        rest = -times(known, poly[:size])
        rest[0] += 2.0
        out = times(known, rest)
    return out


def is_stable(coefs: np.ndarray, sign: float) -> bool:
    """Whether ``1 + sign * (c1 z + c2 z² + …)`` has all roots outside the unit circle."""
    if not len(coefs):
        return True
    if len(coefs) == 1:
        return abs(coefs[0]) < 1
    companion = np.vstack([-sign * np.asarray(coefs), np.eye(len(coefs) - 1, len(coefs))])
    return bool(np.max(np.abs(np.linalg.eigvals(companion))) < 1)


class ArmaShape:
    """Parameter layout ``[beta, phi, theta, seasonal phi, seasonal theta]`` of one order."""

    def __init__(self, order, seasonal=(0, 0, 0, 1), regressors: int = 0):
        self.p, _, self.q = order
        self.P, _, self.Q, season = seasonal
        self.season = max(int(season), 1)
        self.regressors = regressors

    @property
    def size(self) -> int:
        return self.regressors + self.p + self.q + self.P + self.Q

    def parts(self, params: np.ndarray):
        params, parts, low = np.asarray(params, dtype=float), [], 0
        for count in (self.regressors, self.p, self.q, self.P):
            parts.append(params[low : low + count])
            low += count
        return [*parts, params[low:]]

    def factors(self, params: np.ndarray, length: int) -> list[np.ndarray | None]:
        """Series of the four parts of the residual filter; ``None`` for an absent part."""
        _, phi, theta, s_phi, s_theta = self.parts(params)
        return [
            lag_polynomial(phi, -1, 1, length) if self.p else None,
            inverse_series(lag_polynomial(theta, 1, 1, length)) if self.q else None,
            lag_polynomial(s_phi, -1, self.season, length) if self.P else None,
            inverse_series(lag_polynomial(s_theta, 1, self.season, length)) if self.Q else None,
        ]

    def filter(self, params: np.ndarray, length: int) -> np.ndarray:
        """Coefficients of the residual filter: autoregressive over moving-average part."""
        return product_of(length, *self.factors(params, length))

    def filter_and_slopes(self, params: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The residual filter and its derivative by every ARMA parameter."""
        factors = self.factors(params, length)
        taps = product_of(length, *factors)
        return taps, self.slopes(factors, taps, length)

    def slopes(self, factors: list[np.ndarray | None], taps: np.ndarray, length: int) -> np.ndarray:
        """The derivative of the residual filter ``taps``, the product of ``factors``, by every ARMA parameter."""
        ar, ma, s_ar, s_ma = factors
        sources = (
            (self.p, 1, (ma, s_ar, s_ma)),
            (self.q, 1, (taps, ma)),
            (self.P, self.season, (ar, ma, s_ma)),
            (self.Q, self.season, (taps, s_ma)),
        )
        slopes = np.zeros((self.p + self.q + self.P + self.Q, length + 1))
        row = 0
        for count, step, factors in sources:
            series = product_of(length, *factors) if count else None
            for k in range(1, count + 1):
                if k * step <= length:
                    slopes[row, k * step :] = -series[: length + 1 - k * step]
                row += 1
        return slopes

    def admissible(self, params: np.ndarray) -> bool:
        _, phi, theta, s_phi, s_theta = self.parts(params)
        return (
            is_stable(phi, -1) and is_stable(s_phi, -1) and is_stable(theta, 1) and is_stable(s_theta, 1)
        )

    def starts(self) -> list[np.ndarray]:
        """Starting points: none, and mild persistence with opposite moving average."""
        zero = np.zeros(self.size)
        if not (self.q or self.Q):
            return [zero]
        out = [zero]
        for ar, ma in ((0.3, -0.3), (0.3, -0.8), (-0.3, 0.5)):
            start = zero.copy()
            at = self.regressors
            if self.p:
                start[at] = ar
            if self.q:
                start[at + self.p] = ma
            if self.Q:
                start[at + self.p + self.q + self.P] = ma / 2
            out.append(start)
        return out


class SquaredResiduals:
    """Conditional sum of squares of ``filter * (y - beta'x)`` as a function of parameters.

    Channel 0 is the differenced target, channels 1… its regressors.
    """

    def __init__(self, moments: SeriesMoments, shape: ArmaShape):
        self.shape = shape
        self.lags = moments.max_lag
        terms = [(channel, range(self.lags + 1)) for channel in range(1 + shape.regressors)]
        self.block = moments.gram(terms, 0, moments.n - 1)
        self.last = None

    def weights(self, params: np.ndarray, taps: np.ndarray) -> np.ndarray:
        """Weight of every lagged value in the residual."""
        if not self.shape.regressors:
            return taps
        return np.kron(np.append(1.0, -params[: self.shape.regressors]), taps)

    def _filter(self, params: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
        """The filter's factors and their product; a move starts where a value was just asked for."""
        if self.last is None or not np.array_equal(self.last[0], params):
            factors = self.shape.factors(params, self.lags)
            self.last = params.copy(), factors, product_of(self.lags, *factors)
        return self.last[1], self.last[2]

    def value(self, params: np.ndarray) -> float:
        r = self.weights(params, self._filter(params)[1])
        return float(r @ self.block @ r)

    def move(self, params: np.ndarray) -> np.ndarray:
        """Gauss-Newton step."""
        factors, taps = self._filter(params)
        slopes = self.shape.slopes(factors, taps, self.lags)
        regressors = self.shape.regressors
        by_beta = [np.kron(-np.eye(1 + regressors)[1 + k], taps) for k in range(regressors)]
        by_arma = [self.weights(params, slope) for slope in slopes]
        slope = np.array([*by_beta, *by_arma])
        half = slope @ self.block
        return ridge(half @ slope.T, -(half @ self.weights(params, taps)), 1e-10)

    def descend(self, params: np.ndarray, value: float, steps: int, tolerance: float):
        """Up to ``steps`` moves, halved while they raise the sum or leave the stable region."""
        for _ in range(steps):
            move, size = self.move(params), 1.0
            while size > 1e-4:
                trial = params + size * move
                if self.shape.admissible(trial):
                    trial_value = self.value(trial)
                    if trial_value <= value:
                        break
                size /= 2
            else:
                break
            gain = value - trial_value
            params, value = trial, trial_value
            if gain <= tolerance * value:
                break
        return params, value


def fit_arma(moments: SeriesMoments, shape: ArmaShape, steps: int = 60, tolerance: float = 1e-10):
    """``(params, sum_of_squares)``: a few moves from each start, then the best to the end."""
    target = SquaredResiduals(moments, shape)
    starts = [(start, target.value(start)) for start in shape.starts()]
    if not shape.size:
        return starts[0]
    runs = [target.descend(start, value, 6, tolerance) for start, value in starts]
    runs = [run for run in runs if np.isfinite(run[1])]
    if not runs:
        return None, np.inf
    params, value = min(runs, key=lambda run: run[1])
    return target.descend(params, value, steps, tolerance)


def gaussian_aic(sum_of_squares: float, n: int, size: int) -> tuple[float, float]:
    """``(sigma2, aic)`` with the noise variance counted as a parameter."""
    sigma2 = max(sum_of_squares / n, 1e-300)
    return sigma2, n * (np.log(2 * np.pi * sigma2) + 1) + 2 * (size + 1)


def difference(x: np.ndarray, d: int, seasonal: int, season: int) -> np.ndarray:
    for _ in range(d):
        x = x[1:] - x[:-1]
    for _ in range(seasonal):
        x = x[season:] - x[:-season]
    return x


def forecast_arma(recent: np.ndarray, taps: np.ndarray, horizon: int) -> np.ndarray:
    """Extend a differenced series by ``horizon`` steps with zero future noise."""
    path = np.concatenate([recent, np.zeros(horizon)])
    for t in range(len(recent), len(path)):
        reach = min(t, len(taps) - 1)
        path[t] = -(taps[1 : reach + 1] @ path[t - reach : t][::-1])
    return path[len(recent) :]


def integrate(recent: np.ndarray, changes: np.ndarray, d: int, seasonal: int, season: int) -> np.ndarray:
    """Turn forecasts of the differenced series back into levels."""
    if d:
        inner = integrate(recent[1:] - recent[:-1], changes, d - 1, seasonal, season)
        return recent[-1] + np.cumsum(inner)
    if seasonal:
        inner = integrate(recent[season:] - recent[:-season], changes, 0, seasonal - 1, season)
        path = np.concatenate([recent, np.zeros(len(inner))])
        for t in range(len(inner)):
            path[len(recent) + t] = inner[t] + path[len(recent) + t - season]
        return path[len(recent) :]
    return changes


def adf_statistic(moments: SeriesMoments, max_lag: int) -> tuple[float, int, int]:
    """Dickey-Fuller t statistic with a constant; the lag count is chosen by AIC.

    Channel 0 is the (centred) level shifted so that row ``t`` holds ``y[t]``, channel 1 the
    change into row ``t`` (0 in the first row). Candidates are compared on one sample and the
    chosen one is fitted again on all rows it can use.
    """

    def sample(lags: int, low: int):
        # Change at t, earlier changes, level at t-1; then the constant.
        terms = [(1, range(lags + 1)), (0, range(1, 2))]
        high = moments.n - 1
        sums = np.append(moments.lag_sums(terms, low, high), high - low + 1)
        gram = np.zeros((lags + 3, lags + 3))
        gram[:-1, :-1] = moments.gram(terms, low, high)
        gram[-1, :] = gram[:, -1] = sums
        return gram

    def regress(gram: np.ndarray, used: list[int]):
        nobs = gram[-1, -1]
        inverse = np.linalg.pinv(gram[np.ix_(used, used)])
        beta = inverse @ gram[used, 0]
        rss = max(float(gram[0, 0] - beta @ gram[used, 0]), 1e-300)
        level = len(used) - 2
        error = np.sqrt(max(rss / (nobs - len(used)) * inverse[level, level], 1e-300))
        aic = nobs * (np.log(2 * np.pi * rss / nobs) + 1) + 2 * len(used)
        return beta[level] / error, aic

    def choices_of(gram: np.ndarray) -> list[tuple[float, int]]:
        """``aic, lags`` of every candidate. They are nested: one factor has the residuals of all."""
        level, constant = max_lag + 1, max_lag + 2
        nested = [level, constant, *range(1, max_lag + 1)]
        scale = np.sqrt(np.diag(gram))
        try:
            if not scale.all():
                raise np.linalg.LinAlgError
            unit = gram / np.outer(scale, scale)
            factor = np.linalg.cholesky(unit[np.ix_(nested, nested)])
            if np.diag(factor).min() < 1e-4:
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            return [(regress(gram, [*range(1, k + 1), level, constant])[1], k) for k in range(max_lag + 1)]
        explained = np.cumsum(np.linalg.solve(factor, unit[nested, 0]) ** 2)[1:]
        nobs = gram[-1, -1]
        rss = np.maximum(gram[0, 0] * (1.0 - explained), 1e-300)
        aic = nobs * (np.log(2 * np.pi * rss / nobs) + 1) + 2 * (np.arange(max_lag + 1) + 2)
        return list(zip(aic.tolist(), range(max_lag + 1)))

    choices = choices_of(sample(max_lag, max_lag + 1))
    lags = min(choices)[1]
    stat, _ = regress(sample(lags, lags + 1), list(range(1, lags + 3)))
    return float(stat), lags, moments.n - 1 - lags


# MacKinnon's approximate distribution of the statistic (constant, one series):
# the normal quantile of the p-value is a + b*t + c*t² for t up to the break, and
# a + b*t + c*t² + d*t³ above it; the outer limits give p = 0 and p = 1.
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
BREAK, LOWEST, HIGHEST = -1.61, -18.83, 2.74


def adf_p_value(stat: float) -> float:
    from math import erf, sqrt

    if stat <= LOWEST:
        return 0.0
    if stat >= HIGHEST:
        return 1.0
    coefs = SMALL_P if stat <= BREAK else LARGE_P
    z = sum(c * stat**k for k, c in enumerate(coefs))
    return 0.5 * (1 + erf(z / sqrt(2)))
