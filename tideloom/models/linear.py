"""Direct multi-step linear forecaster: a context window of all channels to the next steps.

It stands where the reference models train neural networks for the same task. The normal
equations come from lag moments, so no window is materialised for fitting.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.arrays import dot
from tideloom.functions.times import HOUR, shift
from tideloom.models.moments import SeriesMoments, lag_moments
from tideloom.models.solve import ridge
from tideloom.operators.ordering import attach, keep_last, spread


def _listed(target: str | Sequence[str]) -> list[str]:
    return [target] if isinstance(target, str) else list(target)


def window_linear_fit(
    df: DataFrame,
    keys: Sequence[str],
    context: int,
    horizon: int,
    target: str | Sequence[str] = "value",
    features: Sequence[str] = (),
    penalty: float = 1e-6,
    pos: str = "pos",
    chunk: int | None = None,
    marks: Sequence[str] = (),
) -> DataFrame:
    """``coefs, intercepts, n_windows, status`` per series.

    ``coefs`` has a row for every target and step, target by target. Coefficients run channel by
    channel over the context (targets first, then ``features``), oldest row first, then over the
    steps to come of every one of ``marks``: channels that are known ahead, such as the calendar.
    All targets share one Gram matrix, which the lag moments give; marks are cross moments like
    any other. Needs series of at least ``context + horizon + 1`` rows; shorter ones, and those
    with missing values, get NULL and say so in ``status``.
    """
    targets = _listed(target)
    context_cols = [*targets, *features]
    cols = [*context_cols, *[m for m in marks if m not in context_cols]]
    table = lag_moments(df, cols, keys, context + horizon - 1, pos, chunk)
    fields = [
        *[df.schema[k] for k in keys],
        T.StructField("coefs", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("intercepts", T.ArrayType(T.DoubleType())),
        T.StructField("n_windows", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
    key_names, width = list(keys), len(targets) * horizon
    ahead, back = range(-horizon, 0), range(context)
    terms = [(c, ahead) for c in range(len(targets))] + [(c, back) for c in range(len(context_cols))]
    terms += [(cols.index(m), ahead) for m in marks]
    # Within a channel lags run from the newest row back, and steps from the furthest on.
    order = np.concatenate([np.arange(len(lags))[::-1] + at for at, (_, lags) in zip(_starts(terms), terms)])

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                label = [getattr(row, k) for k in key_names]
                moments = SeriesMoments(row.n, row.sums, row.moments, row.head, row.tail)
                low, high = context - 1, moments.n - 1 - horizon
                count = high - low + 1
                if not np.isfinite(moments.moments).all():
                    out.append([*label, None, None, max(count, 0), "failed: missing values"])
                    continue
                if count < 2:
                    out.append([*label, None, None, max(count, 0), "failed: too few rows"])
                    continue
                sums = moments.lag_sums(terms, low, high)
                gram = moments.gram(terms, low, high) - np.outer(sums, sums) / count
                sums, gram = sums[order], gram[np.ix_(order, order)]
                coefs = ridge(gram[width:, width:], gram[width:, :width], penalty)
                constant = (sums[:width] - coefs.T @ sums[width:]) / count
                out.append([*label, coefs.T.tolist(), constant.tolist(), count, "ok"])
            yield pd.DataFrame(out, columns=[f.name for f in fields])

    return spread(table, keys).mapInPandas(solve, T.StructType(fields))


def _starts(terms: Sequence[tuple[int, range]]) -> np.ndarray:
    return np.cumsum([0, *[len(lags) for _, lags in terms]])[:-1]


def _field(rows: str, name: str) -> Column:
    """One field of an array of structs, as numbers."""
    return F.transform(rows, lambda r: r[name].cast("double"))


def flatten_past(cols: Sequence[str], past: str = "past") -> Column:
    """A window's context in coefficient order."""
    if len(cols) == 1:
        return F.col(past)
    return F.concat(*[F.transform(past, lambda r: r[c].cast("double")) for c in cols])


def window_linear_forecast(
    df: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    context: int,
    cols: Sequence[str] = ("value",),
    period: timedelta = HOUR,
    pos: str = "pos",
    ts: str = "ts",
) -> DataFrame:
    """``keys, step, ts, yhat`` after the last row of every series, from its last context."""
    return forecast_contexts(last_contexts(df, keys, context, cols, pos, ts), models, keys, cols, period, ts)


def last_contexts(
    df: DataFrame, keys: Sequence[str], context: int, cols: Sequence[str] = ("value",), pos: str = "pos", ts: str = "ts"
) -> DataFrame:
    """``keys, _last, past``: the last ``context`` rows of every series that has as many."""
    newest = keep_last(df.select(*keys, pos, ts, *cols), context, keys, pos)
    packed = newest.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(pos, *cols))).alias("_rows"), F.max(ts).alias("_last")
    )
    full = packed.filter(F.size("_rows") == context)
    if len(cols) == 1:
        past = F.transform("_rows", lambda r: r[cols[0]].cast("double"))
    else:
        past = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in cols]))
    return full.select(*keys, "_last", past.alias("past"))


def forecast_contexts(
    windows: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str] = ("value",),
    period: timedelta = HOUR,
    ts: str = "ts",
) -> DataFrame:
    steps = window_linear_predict(windows, models, keys, cols)
    return steps.select(*keys, "step", shift(F.col("_last"), F.col("step"), period).alias(ts), "yhat")


def window_linear_predict(
    windows: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str] = ("value",),
    target: str | Sequence[str] | None = None,
    marks: Sequence[str] = (),
    keep_failed: bool = False,
) -> DataFrame:
    """Forecast of every window: one row per step, with the actual where ``future`` has it.

    ``cols`` are the channels of the context, targets first. A list of targets gives a row per
    target and step, the target's name in ``channel``; ``marks`` are read from ``future``. Windows of
    series without a model are left out, or with ``keep_failed`` are rows without a step that carry the
    model's ``status`` (``no model`` where there is no row at all).
    """
    targets = [cols[0]] if target is None else _listed(target)
    several = target is not None and not isinstance(target, str)
    rows = attach(windows, models.select(*keys, "coefs", "intercepts", "status"), keys, "left" if keep_failed else "inner")
    if not keep_failed:
        rows = rows.filter(F.col("coefs").isNotNull())
    known = [_field("future", m) for m in marks]
    inputs = F.concat(flatten_past(cols), *known) if known else flatten_past(cols)
    scored = F.zip_with("coefs", "intercepts", lambda weights, constant: dot(weights, inputs) + constant)
    horizon = F.floor(F.size("_path") / F.lit(len(targets))).cast("int")
    rows = rows.withColumn("_path", scored).withColumn("_horizon", horizon)
    if "future" in windows.columns:
        plain = len(cols) == 1 and not marks
        actuals = [F.col("future") if plain else _field("future", c) for c in targets]
        rows = rows.withColumn("_actual", F.array(*actuals))
    else:
        rows = rows.withColumn("_actual", F.lit(None).cast("array<array<double>>"))
    kept = [c for c in windows.columns if c not in ("past", "future")]
    explode = F.posexplode_outer if keep_failed else F.posexplode
    steps = rows.select(*kept, "status", "_actual", "_horizon", explode("_path").alias("_at", "yhat"))
    at = F.floor(F.col("_at") / F.col("_horizon")).cast("int")
    step = (F.col("_at") % F.col("_horizon") + 1).cast("int")
    names = [F.element_at(F.array(*[F.lit(t) for t in targets]), at + 1).alias("channel")] if several else []
    actual = F.try_element_at(F.try_element_at("_actual", at + 1), step)
    status = [F.coalesce("status", F.lit("no model")).alias("status")] if keep_failed else []
    return steps.select(*kept, *names, step.alias("step"), actual.alias("value"), "yhat", *status)
