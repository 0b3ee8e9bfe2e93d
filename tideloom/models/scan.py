"""Exact ARMA residuals of series of any length, by a scan of affine maps over chunks.

The residuals of an ARMA model obey a linear recursion, and so do their derivatives by the
parameters. A chunk of a series therefore maps the recursion's state at its start to the state
at its end by an affine map, ``state -> A state + b``: ``b`` is the end state of a run from zero,
and ``A`` the one-step transition to the power of the chunk's length. Maps compose, first inside
blocks of chunks and then over the blocks of a series, which gives every chunk its true incoming
state; a second run over the chunks then has the exact residuals, their sum of squares and its
slopes. Nothing is cut off, whatever the roots, and no task sees more than a chunk of rows or a
block of states.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.models.solve import ArmaShape, inverse_series, lag_polynomial, ridge
from tideloom.operators.ordering import attach, with_halo
from tideloom.session import settle

#: Chunk states that one task composes; the blocks of a series are composed by one more.
BLOCK = 512
#: Rows that one step of the recursion solves at once.
_STEP = 64
#: A fit has converged when the next move would lower the sum of squares by less than this part.
TOLERANCE = 1e-14
#: The part of a move that must stay inside the stable region.
EDGE = 1e-3
#: Moves, halved ones included, after which a fit is reported as not converged.
MOVES = 80

DOUBLES = T.ArrayType(T.DoubleType())


def polynomial(factors: Sequence[np.ndarray]) -> np.ndarray:
    out = np.ones(1)
    for f in factors:
        out = np.convolve(out, f)
    return out


def lagged(taps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``sum(taps[l] * x[t-l])``; values before the first are 0."""
    out = np.zeros_like(x)
    for lag in np.flatnonzero(taps[: len(x)]):
        out[lag:] += taps[lag] * x[: len(x) - lag]
    return out


def stepper(ma: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``recur`` multiplies a step's inputs and the rows ahead of it with."""
    r, size = len(ma) - 1, min(_STEP, rows)
    response = inverse_series(np.concatenate([ma, np.zeros(size)])[:size])
    # Row i is the response backwards from place i: windows of one array.
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([response[::-1], np.zeros(size - 1)]), size)
    solve = np.ascontiguousarray(windows[::-1])
    reach = np.add.outer(np.arange(size), r - np.arange(r))
    return solve, solve @ np.where(reach <= r, ma[np.minimum(reach, r)], 0.0)


def recur(ma: np.ndarray, inputs: np.ndarray, past: np.ndarray, steps: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Columns ``z`` with ``sum(ma[j] * z[t-j]) = inputs[t]``, after the ``past`` rows (oldest first)."""
    r = len(ma) - 1
    if r == 0 or not len(inputs):
        return inputs.copy()
    solve, carry = steps or stepper(ma, len(inputs))
    size = len(solve)
    out = np.empty((r + len(inputs), inputs.shape[1]))
    out[:r] = past
    for low in range(0, len(inputs), size):
        n = min(size, len(inputs) - low)
        out[r + low : r + low + n] = solve[:n, :n] @ inputs[low : low + n] - carry[:n] @ out[low : low + r]
    return out[r:]


@dataclass(frozen=True)
class Model:
    """One model with its parameters: ``code`` is ``p, d, q, P, D, Q, season``."""

    code: tuple[int, ...]
    params: np.ndarray
    mean: float = 0.0
    regressors: int = 0

    @classmethod
    def of(cls, code, params, mean, regressors: int) -> Model:
        return cls(tuple(int(v) for v in code), np.asarray(params, dtype=float), float(mean or 0.0), regressors)

    @property
    def shape(self) -> ArmaShape:
        p, d, q, P, D, Q, s = self.code
        return ArmaShape((p, d, q), (P, D, Q, s), self.regressors)

    @property
    def reach(self) -> int:
        """Rows lost to differencing."""
        return self.code[1] + self.code[4] * self.code[6]

    @property
    def carried(self) -> int:
        """Residuals that the recursion looks back on."""
        return self.code[2] + self.code[5] * self.code[6]

    @property
    def halo(self) -> int:
        """Rows ahead of a chunk that its differenced, autoregressive inputs need."""
        return self.reach + self.code[0] + self.code[3] * self.code[6]

    def factors(self) -> tuple[np.ndarray, ...]:
        """``ar, ma`` and their plain and seasonal factors."""
        s = max(self.code[6], 1)
        _, phi, theta, s_phi, s_theta = self.shape.parts(self.params)
        ar, ma = lag_polynomial(phi, -1, 1, len(phi)), lag_polynomial(theta, 1, 1, len(theta))
        s_ar, s_ma = lag_polynomial(s_phi, -1, s, s * len(s_phi)), lag_polynomial(s_theta, 1, s, s * len(s_theta))
        return polynomial([ar, s_ar]), polynomial([ma, s_ma]), ar, s_ar, ma, s_ma

    def differences(self) -> np.ndarray:
        _, d, _, _, D, _, s = self.code
        unit = np.zeros(s + 1)
        unit[0], unit[s] = 1.0, -1.0
        return polynomial([np.array([1.0, -1.0])] * d + [unit] * D)

    def run(self, levels: np.ndarray, start: int, lead: int, past: np.ndarray, slopes: bool = True) -> np.ndarray:
        """Residuals (column 0) and their slopes by every parameter, of the rows behind the halo.

        ``levels``: a row per channel; its first column is position ``start`` of the series, the
        first ``lead`` ones are halo. ``past``: the last ``carried`` rows of the same columns.
        """
        ar, ma, plain_ar, s_ar, plain_ma, s_ma = self.factors()
        taps, reach = self.differences(), self.reach
        w = np.array([lagged(taps, channel) for channel in levels])
        w[:, : max(reach - start, 0)] = 0.0
        w[0, max(reach - start, 0) :] -= self.mean
        k = self.regressors
        n = w[0] - self.params[:k] @ w[1:]
        inputs = lagged(ar, n)[lead:, None]
        steps = stepper(ma, len(inputs)) if len(ma) > 1 and len(inputs) else None
        e = recur(ma, inputs, past[:, :1], steps)
        if not slopes:
            return e
        shape, s, r = self.shape, max(self.code[6], 1), self.carried
        known = np.concatenate([past[:, 0], e[:, 0]])

        def back(taps: np.ndarray, x: np.ndarray, lag: int, cut: int) -> np.ndarray:
            return -lagged(np.concatenate([np.zeros(lag), taps]), x)[cut:]

        inputs = [back(ar, x, 0, lead) for x in w[1:]]
        inputs += [back(s_ar, n, i, lead) for i in range(1, shape.p + 1)]
        inputs += [back(s_ma, known, i, r) for i in range(1, shape.q + 1)]
        inputs += [back(plain_ar, n, i * s, lead) for i in range(1, shape.P + 1)]
        inputs += [back(plain_ma, known, i * s, r) for i in range(1, shape.Q + 1)]
        return np.hstack([e, recur(ma, np.array(inputs).reshape(len(inputs), len(e)).T, past[:, 1:], steps)])

    def step(self) -> np.ndarray:
        """The transition of the flattened state by one row without input."""
        _, ma, _, _, plain_ma, s_ma = self.factors()
        shape, s, r = self.shape, max(self.code[6], 1), self.carried
        width = 1 + shape.size
        out = np.zeros((r, width, r, width))
        for row in range(r - 1):
            out[row, range(width), row + 1, range(width)] = 1.0
        for lag in range(1, r + 1):
            out[r - 1, range(width), r - lag, range(width)] -= ma[lag]
        first = 1 + self.regressors + shape.p
        slots = [(first + i, i + 1, s_ma) for i in range(shape.q)]
        slots += [(first + shape.q + shape.P + i, (i + 1) * s, plain_ma) for i in range(shape.Q)]
        for column, shift, taps in slots:
            for lag in np.flatnonzero(taps):
                out[r - 1, column, r - shift - lag, 0] -= taps[lag]
        return out.reshape(r * width, r * width)


def last_rows(past: np.ndarray, run: np.ndarray) -> np.ndarray:
    return np.vstack([past, run])[len(run) :]


def sums_of(run: np.ndarray, start: int, common: int) -> np.ndarray:
    """Sum of squares, the same from position ``common`` on, slope products with residuals and each other."""
    e, d = run[:, 0], run[:, 1:]
    late = e[max(common - start, 0) :]
    return np.concatenate([[e @ e, late @ late], d.T @ e, (d.T @ d).ravel()])


@dataclass
class Descent:
    """Gauss-Newton with halved steps; every call of ``tell`` reports on the last ``trial``."""

    shape: ArmaShape
    trial: np.ndarray
    best: np.ndarray | None = None
    value: float = np.inf
    move: np.ndarray | None = None
    size: float = 1.0
    moves: int = 0
    status: str = ""

    def tell(self, sums: np.ndarray) -> bool:
        """Take in ``sums_of`` the trial; whether the trial is the best so far."""
        k = self.shape.size
        better = bool(np.isfinite(sums[0]) and sums[0] <= self.value)
        if better:
            self.best, self.value, self.size = self.trial, float(sums[0]), 1.0
            self.move = self._move(sums[2 : 2 + k], sums[2 + k :].reshape(k, k))
            if self.move is None:
                self.status = "ok"
                return True
        elif self.best is None:
            self.status = "failed: no stable solution"
            return False
        else:
            self.size /= 2
        self.moves += 1
        if self.moves > MOVES:
            self.status = "not converged"
            return better
        while self.size > 1e-6:
            self.trial = self.best + self.size * self.move
            if self.shape.admissible(self.trial):
                return better
            self.size /= 2
        # No shorter move goes down: a minimum to rounding.
        self.status = "ok"
        return better

    def _move(self, cross: np.ndarray, gram: np.ndarray) -> np.ndarray | None:
        """The next move, or None at a minimum.

        A factor of the model (autoregressive, moving-average, seasonal ones) whose own part of the
        move leaves the stable region at once stays where it is, on the region's edge, and the
        others move on without it.
        """
        cuts = np.cumsum([0, self.shape.regressors, self.shape.p, self.shape.q, self.shape.P, self.shape.Q])
        free = np.ones(self.shape.size, bool)
        while free.any():
            move = np.zeros(len(free))
            move[free] = ridge(gram[np.ix_(free, free)], -cross[free], 1e-15)
            if -(cross @ move) <= TOLERANCE * self.value:
                return None
            held = False
            for low, high in zip(cuts[1:], cuts[2:]):
                part = np.zeros(len(free))
                part[low:high] = move[low:high]
                if part.any() and not self.shape.admissible(self.best + EDGE * part):
                    free[low:high], held = False, True
            if not held:
                return move
        return None


def fit_whole(model: Model, levels: np.ndarray, common: int, free: bool) -> tuple[Model, np.ndarray, np.ndarray, str]:
    """Fit a series held in one chunk: the model, its sums, last residuals and status."""
    empty = np.zeros((model.carried, 1 + model.shape.size))
    descent = Descent(model.shape, model.params)
    best = None
    while not descent.status:
        trial = Model(model.code, descent.trial, model.mean, model.regressors)
        run = trial.run(levels, 0, 0, empty)
        sums = sums_of(run, 0, common)
        if descent.tell(sums):
            best = (trial, sums, last_rows(empty, run)[:, 0])
        if not free:
            descent.status = "ok"
    return (*best, descent.status) if best else (model, np.zeros(0), np.zeros(0), descent.status)


# ---- tables ---------------------------------------------------------------------------------


def blocks_of(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], halo: int, pos: str, chunk: int, time: Column | None = None
) -> DataFrame:
    """``keys, _chunk, _start, _lead, _levels``: a written row per chunk, with an array per channel.

    ``pos`` must be dense. NULL cells become NaN. With ``time`` there are also ``_tail``, the last
    ``halo`` rows (one at least) as one array per channel, and ``_time``, the chunk's last time: those of
    a series' last chunk are the series' own.
    """
    times = [] if time is None else [time.cast("timestamp_ntz").alias("_time")]
    rows = with_halo(df.select(*keys, pos, *cols, *times), chunk, before=halo, pos=pos, keys=keys)
    packed = rows.groupBy(*keys, "_chunk").agg(
        F.array_sort(F.collect_list(F.struct(pos, *cols))).alias("_rows"),
        F.count_if(~F.col("_home")).alias("_lead"),
        *[F.max("_time").alias("_time") for _ in times],
    )
    missing = F.lit(float("nan"))
    levels = F.array(*[F.transform("_rows", lambda r: F.coalesce(r[c].cast("double"), missing)) for c in cols])
    # A chunk without rows of its own is only the halo behind the end of a series.
    own = packed.filter(F.size("_rows") > F.col("_lead"))
    ends = []
    if time is not None:
        newest = F.element_at("_rows", -1)[pos] - max(halo, 1)
        own = own.withColumn("_newest", F.filter("_rows", lambda r: r[pos] > newest))
        ends = [F.array(*[F.transform("_newest", lambda r: r[c].cast("double")) for c in cols]).alias("_tail"), "_time"]
    return settle(own.select(*keys, "_chunk", F.col("_rows")[0][pos].alias("_start"), "_lead", levels.alias("_levels"), *ends))


def levels_of(row) -> np.ndarray:
    return np.array([np.asarray(c, dtype=float) for c in row._levels])


def _fields(df: DataFrame, keys: Sequence[str], more: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *[T.StructField(n, t) for n, t in more]])


def _added(parts: DataFrame, by: Sequence[str], arrays: str, rest: Sequence) -> DataFrame:
    """Arrays added cell by cell; cells of a hot group are added map-side first."""
    cells = parts.select(*by, F.posexplode(arrays).alias("_at", "_v")).groupBy(*by, "_at").agg(F.sum("_v").alias("_v"))
    added = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda c: c["_v"]).alias(arrays))
    return added.join(parts.groupBy(*by).agg(*rest), list(by)) if rest else added


class Scan:
    """The distributed part: the same models over the chunks of series that fill more than one.

    ``blocks``: ``blocks_of`` the series. ``common``: the first position that counts towards
    the second sum of ``sums_of``.
    """

    def __init__(self, blocks: DataFrame, keys: Sequence[str], regressors: int, common: int):
        self.blocks, self.keys, self.regressors, self.common = blocks, list(keys), regressors, common
        self.by = [*self.keys, "_id"]

    def _over_blocks(self, trials: DataFrame, compute, more) -> DataFrame:
        """Apply ``compute(row, model)`` to every chunk and trial.

        Trials are matched with the chunks' numbers first, so that the chunks themselves are
        joined on series and chunk and a hot series stays dealt out.
        """
        schema = _fields(self.blocks, self.keys, [("_id", T.IntegerType()), ("_chunk", T.LongType()), *more])
        names, keys, regressors = schema.fieldNames(), self.keys, self.regressors

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False, name=None):
                    row = _Row(dict(zip(batch.columns, row)))
                    model = Model.of(row.code, row.trial, row.mean, regressors)
                    out.append([*[getattr(row, k) for k in keys], row._id, row._chunk, *compute(row, model)])
                yield pd.DataFrame(out, columns=names)

        return trials.join(self.blocks, [*self.keys, "_chunk"]).mapInPandas(run, schema)

    def _numbered(self, trials: DataFrame) -> DataFrame:
        numbers = self.blocks.select(*self.keys, "_chunk")
        return numbers.join(trials.select(*self.by, "code", "trial", "mean"), self.keys)

    def incoming(self, trials: DataFrame) -> DataFrame:
        """``keys, _id, _chunk, _state``: the state ahead of every chunk, flattened."""

        def end_from_zero(row, model):
            levels = levels_of(row)
            empty = np.zeros((model.carried, 1 + model.shape.size))
            run = model.run(levels, row._start, row._lead, empty)
            return [len(run), last_rows(empty, run).ravel().tolist()]

        ends = self._over_blocks(self._numbered(trials), end_from_zero, [("_n", T.LongType()), ("_end", DOUBLES)])
        small = trials.select(*self.by, "code", "trial", "mean")
        maps = settle(ends.withColumn("_block", F.floor(F.col("_chunk") / BLOCK)))
        keys, regressors, by = self.keys, self.regressors, self.by

        def composed(rows: pd.DataFrame, order: str, state: np.ndarray | None):
            """Yield the state ahead of every row, then the state and length after all."""
            first = rows.iloc[0]
            model = Model.of(first["code"], first["trial"], first["mean"], regressors)
            step, powers = model.step(), {}
            state = np.zeros(len(step)) if state is None else state
            rows = rows.sort_values(order)
            for at, n, end in zip(rows[order], rows["_n"], rows["_end"]):
                yield int(at), state
                if n not in powers:
                    powers[n] = np.linalg.matrix_power(step, int(n))
                state = powers[n] @ state + np.asarray(end, dtype=float)
            yield None, state

        def total(rows: pd.DataFrame) -> pd.DataFrame:
            *_, (_, end) = composed(rows, "_chunk", None)
            label = [*[rows.iloc[0][k] for k in by], int(rows.iloc[0]["_block"])]
            return pd.DataFrame([[*label, int(rows["_n"].sum()), end.tolist()]], columns=[*by, "_block", "_n", "_end"])

        def ahead(order: str):
            def apply(rows: pd.DataFrame) -> pd.DataFrame:
                start = rows.iloc[0].get("_state")
                label = [rows.iloc[0][k] for k in by]
                states = composed(rows, order, None if start is None else np.asarray(start, dtype=float))
                out = [[*label, at, state.tolist()] for at, state in states if at is not None]
                return pd.DataFrame(out, columns=[*by, order, "_state"])

            return apply

        id_field = ("_id", T.IntegerType())
        sums = _fields(self.blocks, keys, [id_field, ("_block", T.LongType()), ("_n", T.LongType()), ("_end", DOUBLES)])
        totals = maps.join(small, by).groupBy(*by, "_block").applyInPandas(total, sums)
        top = _fields(self.blocks, keys, [id_field, ("_block", T.LongType()), ("_state", DOUBLES)])
        starts = totals.join(small, by).groupBy(*by).applyInPandas(ahead("_block"), top)
        down = _fields(self.blocks, keys, [id_field, ("_chunk", T.LongType()), ("_state", DOUBLES)])
        inner = maps.join(starts, [*by, "_block"]).join(small, by).groupBy(*by, "_block")
        return settle(inner.applyInPandas(ahead("_chunk"), down))

    def sums(self, trials: DataFrame) -> DataFrame:
        """``keys, _id, _sums, _residuals``: ``sums_of`` every trial, and its last residuals."""
        common = self.common
        # Models without moving-average terms look back on no residuals: their chunks stand alone.
        carried = F.col("code")[2] + F.col("code")[5] * F.col("code")[6] > 0
        looking_back, free = trials.where(carried), trials.where(~carried)
        states = self._numbered(free).select(*self.by, "_chunk", F.array().cast(DOUBLES).alias("_state"))
        if not looking_back.isEmpty():
            states = states.unionByName(self.incoming(looking_back))
        ends = self.blocks.groupBy(*self.keys).agg(F.max("_chunk").alias("_last"))

        def exact(row, model):
            past = np.asarray(row._state, dtype=float).reshape(model.carried, 1 + model.shape.size)
            run = model.run(levels_of(row), row._start, row._lead, past)
            found = sums_of(run, row._start + row._lead, common)
            return [found.tolist(), last_rows(past, run)[:, 0].tolist()]

        asked = states.join(trials.select(*self.by, "code", "trial", "mean"), self.by)
        parts = self._over_blocks(asked, exact, [("_sums", DOUBLES), ("_residuals", DOUBLES)])
        parts = settle(parts.join(ends, self.keys).withColumn("_tail", F.when(F.col("_chunk") == F.col("_last"), F.col("_residuals"))))
        return _added(parts, self.by, "_sums", [F.any_value("_tail", True).alias("_residuals")])


class _Row:
    """A row of a pandas frame whose names may begin with an underscore."""

    def __init__(self, fields: dict):
        self.__dict__.update(fields)


STATE = [
    ("_id", T.IntegerType()),
    ("code", T.ArrayType(T.IntegerType())),
    ("mean", T.DoubleType()),
    ("free", T.BooleanType()),
    ("trial", DOUBLES),
    ("params", DOUBLES),
    ("move", DOUBLES),
    ("size", T.DoubleType()),
    ("moves", T.IntegerType()),
    ("sums", DOUBLES),
    ("residuals", DOUBLES),
    ("status", T.StringType()),
]
RESULT = [("_id", T.IntegerType()), ("params", DOUBLES), ("squares", T.DoubleType()), ("common_squares", T.DoubleType()), ("residuals", DOUBLES), ("status", T.StringType())]


def _whole(blocks: DataFrame, models: DataFrame, keys: Sequence[str], regressors: int, common: int) -> DataFrame:
    """``RESULT`` for series of one chunk, each fitted where its chunk lies."""
    schema = _fields(models, keys, RESULT)
    names, key_names = schema.fieldNames(), list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                row = _Row(dict(zip(batch.columns, values)))
                start = Model.of(row.code, row.params, row.mean, regressors)
                model, sums, residuals, status = fit_whole(start, levels_of(row), common, bool(row.free))
                label = [getattr(row, k) for k in key_names]
                if not len(sums):
                    out.append([*label, row._id, None, None, None, None, status])
                    continue
                out.append([*label, row._id, model.params.tolist(), sums[0], sums[1], residuals.tolist(), status])
            yield pd.DataFrame(out, columns=names)

    return models.join(blocks, list(keys)).mapInPandas(run, schema)


def _advance(state: DataFrame, found: DataFrame, keys: Sequence[str], regressors: int) -> DataFrame:
    """The next trial of every unfinished model, from the sums of the last one."""
    schema = _fields(state, keys, STATE)
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                row = dict(zip(batch.columns, values))
                sums, residuals = np.asarray(row.pop("_sums"), dtype=float), row.pop("_residuals")
                model = Model.of(row["code"], row["trial"], row["mean"], regressors)
                begun = row["params"] is not None
                descent = Descent(model.shape, model.params)
                if begun:
                    best, move = (np.asarray(row[c], dtype=float) for c in ("params", "move"))
                    value = float(row["sums"][0])
                    descent = Descent(model.shape, model.params, best, value, move, row["size"], int(row["moves"]))
                if descent.tell(sums):
                    row |= {"params": row["trial"], "sums": sums.tolist(), "residuals": residuals}
                if not row["free"]:
                    descent.status = "ok"
                row |= {"trial": descent.trial.tolist(), "size": descent.size, "moves": descent.moves}
                row |= {"move": None if descent.move is None else descent.move.tolist(), "status": descent.status}
                out.append([row[c] for c in names])
            yield pd.DataFrame(out, columns=names)

    return state.join(found, [*keys, "_id"]).mapInPandas(run, schema)


def refine(
    blocks: DataFrame, models: DataFrame, keys: Sequence[str], regressors: int, common: int
) -> DataFrame:
    """``RESULT`` of ``models (keys, _id, code, params, mean, free)``: exact least squares from ``params``.

    ``blocks``: ``blocks_of`` the series, with the largest halo of the models. Models that are not
    ``free`` are evaluated as they stand. Series of one chunk are fitted in one task; longer ones by
    passes of ``Scan`` over all of them at once, two a move, until every model has converged or
    used up its moves.
    """
    counts = blocks.groupBy(*keys).agg(F.max("_chunk").alias("_last"))
    models = settle(models.join(counts, list(keys)))
    result = _whole(blocks, models.where("_last = 0").drop("_last"), keys, regressors, common)
    long = models.where("_last > 0").drop("_last")
    if long.isEmpty():
        return result
    blocks = attach(blocks, counts.where("_last > 0"), keys, "left_semi")
    scan = Scan(settle(blocks), keys, regressors, common)
    nothing = {n: F.lit(None).cast(t) for n, t in STATE if n in ("params", "move", "sums", "residuals")}
    state = long.select(*keys, "_id", "code", "mean", "free", F.col("params").alias("trial"))
    state = state.withColumns(nothing | {"size": F.lit(1.0), "moves": F.lit(0), "status": F.lit("")})
    state = settle(state.select(*keys, *[n for n, _ in STATE]))
    done = []
    while True:
        state = settle(_advance(state, scan.sums(state), keys, regressors))
        done.append(state.where("status <> ''"))
        state = state.where("status = ''")
        if state.isEmpty():
            break
    for part in done:
        squares = [F.col("sums")[0].alias("squares"), F.col("sums")[1].alias("common_squares")]
        result = result.unionByName(part.select(*keys, "_id", "params", *squares, "residuals", "status"))
    return result
