"""Rolling-origin backtests: every fold's models from one pass over the data.

A fold trains on the rows ahead of an origin and is scored on the steps behind it. Lagged products
are summed per chunk and by the segment between two origins, and running sums over the few
segments give the lag moments of every training prefix. Each candidate is then fitted and run
forward from one short row per series and fold, so more folds cost no more passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.models.arima import difference_weights
from tideloom.models.moments import SeriesMoments, chunk_groups, cut_up, lagged_products, summed
from tideloom.models.solve import ArmaShape, fit_arma, forecast_arma, integrate, ridge
from tideloom.operators.ordering import CHUNK, attach, chunk_window, drop_halo, keep_first, spread, with_halo
from tideloom.operators.splits import fraction
from tideloom.session import settle

LEVEL = (0, 0, 1)


@dataclass(frozen=True)
class Fold:
    """A training prefix: its moments by channel, its last rows by channel, and the level's shift."""

    moments: SeriesMoments
    mean: float

    def channel(self, at: int) -> SeriesMoments:
        m, w = self.moments, self.moments.width
        return SeriesMoments(m.n, m.sums[at : at + 1], m.moments[at * w + at : at * w + at + 1], m.head[at : at + 1], m.tail[at : at + 1])


@dataclass(frozen=True)
class Autoregression:
    """AR(p) with a constant, by least squares."""

    p: int
    difference = LEVEL

    @property
    def name(self) -> str:
        return f"ar({self.p})"

    @property
    def lags(self) -> int:
        return self.p

    def path(self, fold: Fold, at: int, horizon: int) -> np.ndarray | None:
        m = fold.channel(at)
        count = m.n - self.p
        if count < self.p + 2:
            return None
        terms = [(0, range(self.p + 1))]
        sums = m.lag_sums(terms, self.p, m.n - 1)
        gram = m.gram(terms, self.p, m.n - 1) - np.outer(sums, sums) / count
        coefs = ridge(gram[1:, 1:], gram[1:, 0])
        constant = (sums[0] - coefs @ sums[1:]) / count
        known = list(m.tail[0][-self.p :])
        for _ in range(horizon):
            known.append(constant + coefs @ known[: -self.p - 1 : -1])
        return np.array(known[self.p :]) + fold.mean


@dataclass(frozen=True)
class Arima:
    """ARIMA or SARIMAX without a constant, differenced at least once, by conditional sum of squares.

    The residual filter reaches back ``lags`` rows: exact without moving-average terms, and with
    them up to their root to that power.
    """

    order: tuple[int, int, int]
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 1)
    terms: int = 48

    @property
    def name(self) -> str:
        tail = ",".join(map(str, self.seasonal))
        return f"arima({','.join(map(str, self.order))})" + (f"({tail})" if any(self.seasonal[:3]) else "")

    @property
    def difference(self) -> tuple[int, int, int]:
        return self.order[1], self.seasonal[1], self.seasonal[3]

    @property
    def lags(self) -> int:
        (p, d, q), (P, D, Q, s) = self.order, self.seasonal
        back = max(p + P * s, self.terms if q or Q else 0)
        # Levels are integrated from the last rows, of which there are twice as many and one.
        return max(back, math.ceil((d + D * s) / 2))

    def path(self, fold: Fold, at: int, horizon: int) -> np.ndarray | None:
        (_, d, _), (_, D, _, s) = self.order, self.seasonal
        m, shape = fold.channel(at), ArmaShape(self.order, self.seasonal)
        if m.n - d - D * s < shape.size + 3 or m.moments[0, 0] <= 1e-12:
            return None
        params, _ = fit_arma(m, shape)
        if params is None:
            return None
        changes = forecast_arma(m.tail[0], shape.filter(params, m.max_lag), horizon)
        return integrate(fold.moments.tail[0], changes, d, D, s) + fold.mean


@dataclass(frozen=True)
class Repeat:
    """The last ``season`` rows over and over."""

    season: int
    difference = LEVEL

    @property
    def name(self) -> str:
        return f"repeat({self.season})"

    @property
    def lags(self) -> int:
        return math.ceil(self.season / 2)

    def path(self, fold: Fold, at: int, horizon: int) -> np.ndarray | None:
        if fold.moments.n < self.season:
            return None
        return np.resize(fold.moments.tail[at][-self.season :], horizon) + fold.mean


@dataclass(frozen=True)
class Window:
    """The linear model of the last ``context`` rows to the next ``horizon``."""

    context: int
    horizon: int
    penalty: float = 1e-6
    difference = LEVEL

    @property
    def name(self) -> str:
        return f"window({self.context},{self.horizon})"

    @property
    def lags(self) -> int:
        return self.context + self.horizon - 1

    def path(self, fold: Fold, at: int, horizon: int) -> np.ndarray | None:
        m, h = fold.channel(at), self.horizon
        low, high = self.context - 1, m.n - 1 - h
        count = high - low + 1
        if count < 2 or horizon > h:
            return None
        terms = [(0, range(-h, 0)), (0, range(self.context))]
        sums = m.lag_sums(terms, low, high)
        gram = m.gram(terms, low, high) - np.outer(sums, sums) / count
        coefs = ridge(gram[h:, h:], gram[h:, :h], self.penalty)
        constant = (sums[:h] - coefs.T @ sums[h:]) / count
        steps = constant + m.tail[0][: -self.context - 1 : -1] @ coefs
        return steps[::-1][:horizon] + fold.mean


def _channels(df: DataFrame, keys: Sequence[str], differences: Sequence[tuple], value: str, pos: str, chunk: int) -> DataFrame:
    """The level around its series' mean, and its differences as ``_c0, _c1…``; 0 where history is short."""
    weights = [difference_weights(*d) for d in differences]
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count("*").alias("_n"))
    rows = attach(df.select(*keys, pos, F.col(value).cast("double").alias("_value")), means, keys)
    rows = with_halo(rows.withColumn("_level", F.col("_value") - F.col("_mean")), chunk, before=max(map(max, weights)), pos=pos, keys=keys)
    order = chunk_window(keys, pos)

    def change(taps: dict[int, int]) -> Column:
        terms = [(F.lag("_level", lag).over(order) if lag else F.col("_level")) * F.lit(w) for lag, w in taps.items()]
        return F.when(F.col(pos) >= max(taps), sum(terms[1:], terms[0])).otherwise(0.0)

    return drop_halo(rows.withColumns({f"_c{i}": change(taps) for i, taps in enumerate(weights)})).drop("_level")


def prefix_moments(
    rows: DataFrame, cols: Sequence[str], keys: Sequence[str], max_lag: int, shares: Sequence[float], pos: str, chunk: int
) -> DataFrame:
    """``keys, _fold, n, sums, moments, tail``: the lag moments of every training prefix, by one pass.

    ``rows`` carry their series' length ``_n``. Fold ``k`` is the rows ahead of ``floor(shares[k] * n)``.
    """
    width, folds, names, key_names = len(cols), len(shares), list(cols), list(keys)
    origins = [fraction(F.col("_n"), share).cast("long") for share in shares]
    segment = sum([(F.col(pos) >= o).cast("int") for o in origins], F.lit(0)).alias("_segment")
    marked = rows.select(*keys, pos, *cols, segment, F.array(*origins).alias("_origins"))
    halo = with_halo(marked.drop("_origins"), chunk, before=max_lag, pos=pos, keys=keys)
    cells = width * width * (max_lag + 1)
    fields = [
        *[rows.schema[k] for k in keys],
        T.StructField("_segment", T.IntegerType()),
        T.StructField("products", T.ArrayType(T.DoubleType())),
    ]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = [*[batch.schema.field(k).type for k in key_names], pa.int32(), pa.list_(pa.float64())]
                yield batch

        def packed(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), kinds)], [f.name for f in fields])

        out = []
        for label, found in chunk_groups(seen(), [*key_names, "_chunk"], ["_home", "_segment", *names]):
            home = int((~found["_home"].astype(bool)).sum())
            values, parts = np.column_stack([found[c] for c in names]), found["_segment"][home:]
            for part in np.unique(parts[parts < folds]):
                out.append([*label[:-1], int(part), lagged_products(values, home, max_lag, parts == part).ravel().tolist()])
            if len(out) >= 256:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    sorted_rows = spread(halo, [*keys, "_chunk"]).sortWithinPartitions(*keys, "_chunk", pos)
    partial = sorted_rows.mapInArrow(multiply, T.StructType(fields))
    # A segment counts in every fold that ends behind it.
    later = F.explode(F.sequence(F.col("_segment"), F.lit(folds - 1))).alias("_fold")
    added = summed(partial, [*keys, "_segment"], "products", cells)
    added = summed(added.select(*keys, later, "products"), [*keys, "_fold"], "products", cells)
    table = added.select(*keys, "_fold", cut_up(F.col("products"), width * width, max_lag + 1).alias("moments"))
    sums = marked.where(F.col("_segment") < folds).groupBy(*keys, "_segment")
    sums = sums.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in cols])
    sums = sums.select(*keys, later, "n", *cols).groupBy(*keys, "_fold")
    sums = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(c) for c in cols]).alias("sums"))
    near = marked.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    origin = F.get("_origins", F.col("_fold"))
    near = near.where((F.col(pos) < origin) & (F.col(pos) >= origin - (2 * max_lag + 1)))
    tail = near.groupBy(*keys, "_fold").agg(F.array_sort(F.collect_list(F.struct(pos, *cols))).alias("_rows"))
    tail = tail.select(*keys, "_fold", F.array(*[F.transform("_rows", lambda r: r[c]) for c in cols]).alias("tail"))
    by = [*keys, "_fold"]
    return table.join(sums, by).join(tail, by)


def backtest(
    df: DataFrame,
    candidates: Sequence,
    keys: Sequence[str],
    horizon: int,
    shares: Sequence[float] = (0.6, 0.7, 0.8),
    value: str = "value",
    pos: str = "pos",
    chunk: int | None = None,
) -> DataFrame:
    """``keys, model, fold, origin, steps, squares``: the squared errors of every candidate on every fold.

    ``shares`` rise and give the folds' origins as parts of a series' length; a fold is scored on
    the up to ``horizon`` rows from its origin on. A candidate that cannot be fitted on a fold has
    NULL ``squares``, as have all on a fold whose series holds a missing value. Folds without rows to
    train on or to score are left out. ``pos`` must be dense.
    """
    differences = list(dict.fromkeys([LEVEL, *[c.difference for c in candidates]]))
    place = [differences.index(c.difference) for c in candidates]
    max_lag = max(c.lags for c in candidates)
    chunk = chunk or max(CHUNK, 4 * max_lag)
    cols = [f"_c{i}" for i in range(len(differences))]
    # Read for the products, the edges and the scores.
    rows = settle(_channels(df, keys, differences, value, pos, chunk))
    table = prefix_moments(rows, cols, keys, max_lag, shares, pos, chunk)
    head = keep_first(rows, 2 * max_lag + 1, pos).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(pos, *cols))).alias("_rows"), F.first("_mean").alias("_mean")
    )
    head = head.select(*keys, "_mean", F.array(*[F.transform("_rows", lambda r: r[c]) for c in cols]).alias("head"))
    origins = F.array(*[fraction(F.col("_n"), share).cast("long") for share in shares])
    ahead = rows.select(*keys, pos, "_value", F.posexplode(origins).alias("_fold", "origin"))
    ahead = ahead.where((F.col(pos) >= F.col("origin")) & (F.col(pos) < F.col("origin") + horizon))
    ahead = ahead.groupBy(*keys, "_fold", "origin").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(pos, "_value"))), lambda r: r["_value"]).alias("_actual")
    )
    tasks = attach(table.join(ahead, [*keys, "_fold"]), head, keys)
    schema = T.StructType(
        [
            *[df.schema[k] for k in keys],
            T.StructField("model", T.StringType()),
            T.StructField("fold", T.IntegerType()),
            T.StructField("origin", T.LongType()),
            T.StructField("steps", T.IntegerType()),
            T.StructField("squares", T.DoubleType()),
        ]
    )
    names, key_names = schema.fieldNames(), list(keys)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                row = dict(zip(batch.columns, values))
                n = int(row["n"])
                begin = [np.asarray(c, dtype=float)[:n] for c in row["head"]]
                fold = Fold(SeriesMoments(n, row["sums"], row["moments"], begin, row["tail"]), float(row["_mean"] or 0.0))
                actual = np.asarray(row["_actual"], dtype=float)
                sound = np.isfinite(fold.moments.moments).all() and np.isfinite(actual).all()
                for candidate, at in zip(candidates, place):
                    path = candidate.path(fold, at, horizon) if sound else None
                    squares = None if path is None else float(((path[: len(actual)] - actual) ** 2).sum())
                    label = [row[k] for k in key_names]
                    out.append([*label, candidate.name, row["_fold"], row["origin"], len(actual), squares])
            yield pd.DataFrame(out, columns=names)

    return spread(tasks, [*keys, "_fold"]).mapInPandas(score, schema)


def backtest_scores(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, model, rmse`` over all folds; NULL for a candidate that failed on any."""
    sums = folds.groupBy(*keys, "model").agg(
        F.sum("squares").alias("_squares"), F.sum("steps").alias("_steps"), F.count_if(F.col("squares").isNull()).alias("_failed")
    )
    rmse = F.when(F.col("_failed") == 0, F.sqrt(F.col("_squares") / F.col("_steps")))
    return sums.select(*keys, "model", rmse.alias("rmse"))
