"""Lagged cross moments: the one pass over the data behind every fitted model.

For channels ``a`` and ``b`` and lags ``d = 0 … L`` the table holds ``sum(a[u] * b[u-d])``
over a whole series, plus the series' first and last few rows. Sums of lagged products over
any sample of a regression on lags follow from these by taking the edge terms off, so an
autoregression, a seasonal model with regressors or a multi-step window regression of a
series of any length is fitted from one short row per series.

The pass itself is a shuffle by ``(series, chunk)``: numpy multiplies inside one chunk,
Spark adds the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.operators.ordering import CHUNK, attach, spread, with_halo
from tideloom.session import settle


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def chunk_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str], cols: Sequence[str]) -> Iterator[tuple[list, dict[str, np.ndarray]]]:
    """``label, columns`` of every run of rows that agree in ``by``.

    The rows must be sorted by ``by``. A run may go on in the next batch; no more than one run and
    one batch are held.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        if not len(table):
            continue
        ends = np.unique(np.concatenate([pc.run_end_encode(table[c].chunk(0)).run_ends.to_numpy() for c in by]))
        starts = np.concatenate([[0], ends[:-1]])
        yield from _runs(table, by, cols, starts[:-1], ends[:-1])
        held = table.slice(starts[-1])
    if held is not None:
        yield from _runs(held, by, cols, [0], [len(held)])


def _runs(table: pa.Table, by: Sequence[str], cols: Sequence[str], starts, ends):
    values = {c: table[c].to_numpy() for c in cols}
    labels = [table[c] for c in by]
    for low, high in zip(starts, ends):
        yield [c[int(low)].as_py() for c in labels], {c: v[low:high] for c, v in values.items()}


def lagged_products(values: np.ndarray, home: int, max_lag: int, picked: np.ndarray | None = None) -> np.ndarray:
    """``[a, b, d]``: sums of ``a[u] * b[u-d]`` over the rows behind the ``home`` first (``picked`` of them)."""
    width = values.shape[1]
    padded = np.vstack([np.zeros((max_lag - home, width)), values])
    own = values[home:] if picked is None else values[home:][picked]
    out = np.empty((width, width, max_lag + 1))
    for b in range(width):
        lagged = np.lib.stride_tricks.sliding_window_view(padded[:, b], max_lag + 1)[:, ::-1]
        out[:, b] = own.T @ (lagged if picked is None else lagged[picked])
    return out


def summed(parts: DataFrame, by: Sequence[str], name: str, size: int) -> DataFrame:
    """Arrays of ``size`` cells added cell by cell, those of a task before they are shuffled."""
    if size > 256:
        cells = parts.select(*by, F.posexplode(name).alias("_at", "_v")).groupBy(*by, "_at").agg(F.sum("_v").alias("_v"))
        cells = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias(name))
        return cells.withColumn(name, F.transform(name, lambda c: c["_v"]))
    cells = parts.groupBy(*by).agg(*[F.sum(F.col(name)[i]).alias(f"_{i}") for i in range(size)])
    return cells.select(*by, F.array(*[f"_{i}" for i in range(size)]).alias(name))


def cut_up(flat: Column, pieces: int, size: int) -> Column:
    """An array as ``pieces`` arrays of ``size`` cells."""
    return F.array(*[F.slice(flat, i * size + 1, F.lit(size)) for i in range(pieces)])


def lag_moments(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    max_lag: int,
    pos: str = "pos",
    chunk: int | None = None,
) -> DataFrame:
    """One row per series: ``n``, ``sums[a]``, ``moments[a*m+b][d]``, ``head[a]``, ``tail[a]``.

    ``cols`` must be free of NULL and ``pos`` dense. ``head`` holds the first and ``tail`` the
    last ``2 * max_lag + 1`` rows (fewer in a shorter series). Rows without a key are left out.

    A chunk gives one short row with its sums and its first and last rows. That of a series within
    one chunk is the answer already; the others are added up by series.
    """
    chunk = chunk or max(CHUNK, 4 * max_lag)
    width, reach, names, key_names = len(cols), 2 * max_lag + 1, list(cols), list(keys)
    cells = width * width * (max_lag + 1)
    df = df.select(*keys, pos, *[F.col(c).cast("double").alias(c) for c in cols])
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    rows = with_halo(df, chunk, before=max_lag, pos=pos, keys=keys)
    doubles = T.ArrayType(T.DoubleType())
    fields = [
        *_key_fields(df, keys),
        T.StructField("_chunk", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("_cells", doubles),
        T.StructField("head", T.ArrayType(doubles)),
        T.StructField("tail", T.ArrayType(doubles)),
    ]
    kinds = [pa.list_(pa.float64())] + [pa.list_(pa.list_(pa.float64()))] * 2

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema = [], None

        def packed() -> pa.RecordBatch:
            label = [pa.array([r[i] for r in out], schema.field(k).type) for i, k in enumerate([*key_names, "_chunk"])]
            rest = zip(zip(*[r[len(label) + 1 :] for r in out]), kinds)
            n = pa.array([r[len(label)] for r in out], pa.int64())
            return pa.RecordBatch.from_arrays([*label, n, *[pa.array(list(v), t) for v, t in rest]], [f.name for f in fields])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield batch

        for label, found in chunk_groups(seen(), [*key_names, "_chunk"], ["_home", pos, *names]):
            home = int((~found["_home"].astype(bool)).sum())
            values = np.column_stack([found[c] for c in names])
            own, place = values[home:], found[pos][home:]
            if not len(own):
                continue
            products = lagged_products(values, home, max_lag)
            flat = np.concatenate([np.nansum(own, axis=0), products.ravel()])
            out.append([*label, len(own), flat.tolist(), own[place < reach].T.tolist(), own[-reach:].T.tolist()])
            if len(out) == 256:
                yield packed()
                out.clear()
        if out:
            yield packed()

    # Sorted and cut up in one pass over a task's rows: a call for every chunk would cost more than its products.
    sorted_rows = spread(rows, [*keys, "_chunk"]).sortWithinPartitions(*keys, "_chunk", pos)
    parts = settle(sorted_rows.mapInArrow(multiply, T.StructType(fields)))
    # Positions are dense: a first chunk that is not full is its whole series.
    alone = (F.col("_chunk") == 0) & (F.col("n") < chunk)
    several = parts.where(~alone)
    sums = summed(several, keys, "_cells", width + cells)
    ends = several.groupBy(*keys).agg(F.max("_chunk").alias("_last"), F.sum("n").alias("n"))
    near = attach(several.select(*keys, "_chunk", "head", "tail"), ends.select(*keys, "_last"), keys)
    span = -(-reach // chunk)
    near = near.where((F.col("_chunk") < span) | (F.col("_chunk") >= F.col("_last") - span))
    near = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", "head", "tail"))).alias("_parts"))

    def joined(name: str) -> list[Column]:
        return [F.flatten(F.transform("_parts", lambda r: r[name][c])) for c in range(width)]

    newest = [F.slice(x, F.greatest(F.size(x) - (reach - 1), F.lit(1)), F.lit(reach)) for x in joined("tail")]
    near = near.select(*keys, F.array(*joined("head")).alias("head"), F.array(*newest).alias("tail"))
    added = sums.join(ends.select(*keys, "n"), list(keys)).join(near, list(keys))
    table = parts.where(alone).select(*keys, "n", "_cells", "head", "tail").unionByName(added)
    products = F.slice("_cells", width + 1, F.lit(cells))
    return table.select(
        *keys,
        cut_up(products, width * width, max_lag + 1).alias("moments"),
        "n",
        F.slice("_cells", 1, F.lit(width)).alias("sums"),
        "head",
        "tail",
    )


class SeriesMoments:
    """Sums over any sample of one series, from its row of ``lag_moments``."""

    def __init__(self, n, sums, moments, head, tail):
        self.n = int(n)
        self.sums = np.asarray(sums, dtype=float)
        self.width = len(self.sums)
        self.moments = np.array([np.asarray(m, dtype=float) for m in moments])
        self.max_lag = self.moments.shape[1] - 1
        self.head = np.array([np.asarray(h, dtype=float) for h in head])
        self.tail = np.array([np.asarray(t, dtype=float) for t in tail])

    @classmethod
    def of(cls, values: np.ndarray, max_lag: int) -> SeriesMoments:
        """Those of a series held whole: a row of ``values`` per channel."""
        width, n = values.shape
        padded = np.hstack([np.zeros((width, max_lag)), values])
        cells = [None] * (width * width)
        for b in range(width):
            lagged = np.lib.stride_tricks.sliding_window_view(padded[b], max_lag + 1)[:, ::-1] if n else np.zeros((0, max_lag + 1))
            for a, products in enumerate(values @ lagged):
                cells[a * width + b] = products
        reach = 2 * max_lag + 1
        return cls(n, values.sum(axis=1), cells, values[:, :reach], values[:, -reach:])

    def _run(self, channel: int, low: int, high: int) -> np.ndarray:
        """Values at positions ``[low, high)``, which lie within the head or within the tail."""
        if high <= self.head.shape[1]:
            return self.head[channel, low:high]
        start = self.n - self.tail.shape[1]
        return self.tail[channel, low - start : high - start]

    def _backward(self, channel: int, newest: int, count: int) -> np.ndarray:
        """Values at ``newest, newest - 1, …``; positions outside the series are 0."""
        out = np.zeros(count)
        low, high = max(newest - count + 1, 0), min(newest, self.n - 1)
        if low <= high:
            out[newest - high : newest - low + 1] = self._run(channel, low, high + 1)[::-1]
        return out

    def total(self, channel: int, low: int, high: int) -> float:
        """Sum of positions ``low … high`` (both included); the ends lie near the edges."""
        low, high = max(low, 0), min(high, self.n - 1)
        if high < low:
            return 0.0
        before = self._run(channel, 0, low).sum()
        after = self._run(channel, high + 1, self.n).sum()
        return float(self.sums[channel] - before - after)

    def product(self, a: int, i: int, b: int, j: int, low: int, high: int) -> float:
        """``sum(a[t-i] * b[t-j])`` for ``t = low … high``; positions outside count as 0.

        The whole-series moment less the products before and after the sample.
        """
        if i > j:
            a, i, b, j = b, j, a, i
        lag = j - i
        first, last = max(low - i, lag), min(high - i, self.n - 1)
        if last < first:
            return 0.0
        out = self.moments[a * self.width + b, lag]
        if first > lag:
            out = out - self._run(a, lag, first) @ self._run(b, 0, first - lag)
        if last < self.n - 1:
            out = out - self._run(a, last + 1, self.n) @ self._run(b, last + 1 - lag, self.n - lag)
        return float(out)

    def block(self, a: int, b: int, lags_a: range, lags_b: range, low: int, high: int) -> np.ndarray:
        """``product`` for all ``i`` in ``lags_a`` and ``j`` in ``lags_b``.

        Negative lags look ahead. Differences of lags must stay within ``max_lag``, and the
        sample within that reach of both ends. One step down a diagonal moves the sample back
        by one row: one product enters at the front and one leaves at the end.
        """
        out = np.zeros((len(lags_a), len(lags_b)))
        if high < low:
            return out
        out[0] = [self.product(a, lags_a[0], b, j, low, high) for j in lags_b]
        out[1:, 0] = [self.product(a, i, b, lags_b[0], low, high) for i in lags_a[1:]]
        steps = len(lags_b) - 1
        front_a = self._backward(a, low - 1 - lags_a[0], len(lags_a))
        end_a = self._backward(a, high - lags_a[0], len(lags_a))
        front_b = self._backward(b, low - 1 - lags_b[0], steps)
        end_b = self._backward(b, high - lags_b[0], steps)
        change = np.outer(front_a, front_b) - np.outer(end_a, end_b)
        for row in range(1, len(lags_a)):
            out[row, 1:] = out[row - 1, :-1] + change[row - 1]
        return out

    def gram(self, terms: Sequence[tuple[int, range]], low: int, high: int) -> np.ndarray:
        """Symmetric matrix over the lags of several channels, in the order given."""
        edges = np.cumsum([0] + [len(lags) for _, lags in terms])
        out = np.zeros((edges[-1], edges[-1]))
        for p, (a, lags_a) in enumerate(terms):
            for q, (b, lags_b) in enumerate(terms[p:], start=p):
                part = self.block(a, b, lags_a, lags_b, low, high)
                out[edges[p] : edges[p + 1], edges[q] : edges[q + 1]] = part
                out[edges[q] : edges[q + 1], edges[p] : edges[p + 1]] = part.T
        return out

    def lag_sums(self, terms: Sequence[tuple[int, range]], low: int, high: int) -> np.ndarray:
        return np.array([self.total(c, low - lag, high - lag) for c, lags in terms for lag in lags])
