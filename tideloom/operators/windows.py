"""Training windows.

``cut_windows`` serves every window shape: rows are collected once per chunk (a bounded
number of positions plus the look-ahead halo) and windows are slices of that array. Rows
are shuffled about once, not once per window they fall into.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions import arrays
from tideloom.functions.calendar import calendar_by_freq, calendar_cyclic
from tideloom.functions.times import shift
from tideloom.operators.ordering import CHUNK, attach, series_length, spread, with_halo
from tideloom.operators.scaling import fit_standard, scale
from tideloom.operators.splits import MONTH_DAYS, calendar_spans, label_spans
from tideloom.session import settle

#: Places behind the end of a pyramid's level that are filled without looking at the rows below.
STAND_INS = 4096


def _constant(value: int | str) -> Column:
    return F.col(value) if isinstance(value, str) else F.lit(value)


def cut_windows(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    context: int,
    horizon: int,
    stride: int = 1,
    first: int | str = 0,
    count: int | str | None = None,
    pos: str = "pos",
    chunk: int | None = None,
) -> DataFrame:
    """``keys, window_id, start, past, future`` for every full window.

    Windows start at ``first, first + stride, …``; ``count`` limits their number per series. A
    position may have no row: windows that would cover it are left out, and the others keep their
    numbers. Positions must be distinct within a series.
    Both may name a column that is constant in a series. ``past`` and ``future`` are arrays
    of structs with ``cols`` (plain arrays when there is one column).
    """
    opened = _opened(df, cols, keys, context + horizon, stride, first, count, pos, chunk)
    place, names = F.col("_place"), {c: c for c in cols}

    def part(start: Column, size: int) -> Column:
        return F.slice("_c0", start, F.lit(size)) if len(cols) == 1 else _part(cols, names, start, size)

    past, future = part(place, context).alias("past"), part(place + context, horizon).alias("future")
    return opened.select(*keys, "window_id", "start", past, future)


def _opened(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    length: int,
    stride: int,
    first: int | str,
    count: int | str | None,
    pos: str,
    chunk: int | None,
) -> DataFrame:
    """``keys, window_id, start, _place, _c0, _c1…`` for every full window: its place in its chunk's arrays."""
    chunk = chunk or max(CHUNK, 4 * length)
    rows = with_halo(df, chunk, after=length - 1, pos=pos, keys=keys)
    entry = F.struct(F.col(pos).alias("_at"), *cols)
    # Sized by its input a task could be given far more windows than its neighbours.
    blocks = spread(rows, [*keys, "_chunk"]).groupBy(*keys, "_chunk").agg(
        F.array_sort(F.collect_list(entry)).alias("_rows"),
        F.max(_constant(first)).cast("bigint").alias("_first"),
        (F.max(_constant(count)) if count is not None else F.lit(None)).cast("bigint").alias("_count"),
    )
    low, high = F.col("_chunk") * chunk, (F.col("_chunk") + 1) * chunk

    def opens(at: Column) -> Column:
        """Whether a window begins at the row in place ``at`` (from 1) and no position of it is missing."""
        start, end = F.get("_rows", at - 1)["_at"], F.get("_rows", at + (length - 2))["_at"]
        number = (start - F.col("_first")) / F.lit(stride)
        counted = (start >= F.col("_first")) & (number == F.floor(number))
        counted = counted & (F.col("_count").isNull() | (number < F.col("_count")))
        return (start >= low) & (start < high) & counted & (end == start + (length - 1))

    # Positions are distinct and sorted: a window is whole if its last row lies where it should.
    room = F.size("_rows") - (length - 1)
    searched = F.filter(F.sequence(F.lit(1), F.greatest(room, F.lit(1))), opens)
    # Where no position is missing, places follow from positions.
    base = F.col("_rows")[0]["_at"]
    begin = F.greatest(low, F.col("_first"), base)
    begin = F.col("_first") + F.ceil((begin - F.col("_first")) / F.lit(stride)) * stride
    end = F.least(high - 1, base + F.size("_rows") - length, F.col("_first") + (F.col("_count") - 1) * stride)
    counted = F.when(begin <= end, F.sequence((begin - base + 1).cast("int"), (end - base + 1).cast("int"), F.lit(stride)))
    dense = F.element_at("_rows", -1)["_at"] - base + 1 == F.size("_rows")
    places = F.when((room > 0) & dense, counted).when(room > 0, searched)
    # One array per column, made once per block: a window then copies its own cells and no others.
    channels = [F.col("_rows").getField(c).alias(f"_c{i}") for i, c in enumerate(cols)]
    opened = blocks.select(*keys, "_first", F.col("_rows").getField("_at").alias("_at"), *channels, places.alias("_places"))
    opened = opened.withColumn("_place", F.explode("_places")).drop("_places")
    start = F.get("_at", F.col("_place") - 1).cast("bigint")
    number = F.floor((start - F.col("_first")) / F.lit(stride))
    return opened.select(*keys, number.alias("window_id"), start.alias("start"), "_place", *[f"_c{i}" for i in range(len(cols))])


def _part(cols: Sequence[str], names: Mapping[str, str], start: Column, size: int) -> Column:
    """Cells of an opened window as an array of structs: ``names`` gives a field's column."""
    pieces = [F.slice(f"_c{list(cols).index(c)}", start, F.lit(size)).alias(n) for n, c in names.items()]
    return F.arrays_zip(*pieces)


def strided_panel_windows(
    df: DataFrame,
    keys: Sequence[str],
    seq_len: int,
    pred_len: int,
    end: int | str,
    first: int | str = 0,
    stride: int = 24,
    cols: Sequence[str] = ("value",),
    pos: str = "pos",
    chunk: int | None = None,
) -> DataFrame:
    """Windows every ``stride`` rows: ``(end - first - seq - pred) // stride`` per series.

    That count leaves out the last window that would still fit, as the count of the model
    family this serves does. For test windows pass the test start as ``first`` and the
    series length as ``end``.
    """
    room = _constant(end) - _constant(first) - (seq_len + pred_len)
    rows = df.withColumn("_windows", F.greatest(F.floor(room / F.lit(stride)), F.lit(0)))
    return cut_windows(
        rows, cols, keys, seq_len, pred_len, stride, first, "_windows", pos, chunk
    )


def windows_with_time_features(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    context: int,
    horizon: int,
    stride: int = 1,
    ts: str = "ts",
    pos: str = "pos",
    chunk: int | None = None,
) -> DataFrame:
    """Windows whose rows carry the eight cyclic calendar features beside the channels, with
    ``past_observed_mask`` (1 where the first channel is present)."""
    features = calendar_cyclic(F.col(ts))
    rows = df.withColumns(features)
    windows = cut_windows(rows, [*cols, *features], keys, context, horizon, stride, pos=pos, chunk=chunk)
    return with_observed_mask(windows, cols[0])


def windows_with_marks(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    seq_len: int,
    pred_len: int,
    ticks_per_hour: int = 1,
    month_days: int = MONTH_DAYS,
    freq: str = "h",
    inverse: bool = False,
    ts: str = "ts",
    pos: str = "pos",
    chunk: int | None = None,
) -> DataFrame:
    """Calendar split, standard scaling fit on the training rows, normalised calendar marks,
    then stride-1 windows inside each split. With ``inverse`` the future keeps raw values."""
    spans = calendar_spans(seq_len, ticks_per_hour, month_days=month_days)
    marks = calendar_by_freq(F.col(ts), freq)
    raw = {f"{c}_raw": F.col(c) for c in cols} if inverse else {}
    fitted = fit_standard(df.filter(F.col(pos) < spans[0].high), cols, keys)
    rows = scale(df.withColumns(raw), fitted, cols, keys) if inverse else scale(df, fitted, cols, keys)
    start = F.coalesce(*[F.when(F.col("split") == s.name, s.low) for s in spans])
    rows = label_spans(rows.withColumns(marks), spans, pos)
    rows = rows.withColumn(pos, (F.col(pos) - start).cast("bigint"))
    held, place = [*cols, *raw, *marks], F.col("_place")
    windows = _opened(rows, held, [*keys, "split"], seq_len + pred_len, 1, 0, None, pos, chunk)
    channels = {c: c for c in cols}
    future = {c: f"{c}_raw" for c in cols} if inverse else channels
    names = {m: m for m in marks}
    return windows.select(
        *keys,
        "split",
        "window_id",
        _part(held, channels, place, seq_len).alias("past"),
        _part(held, future, place + seq_len, pred_len).alias("future"),
        _part(held, names, place, seq_len).alias("past_marks"),
        _part(held, names, place + seq_len, pred_len).alias("future_marks"),
    )


def with_observed_mask(windows: DataFrame, column: str | None = None) -> DataFrame:
    """All-ones mask beside ``past``, or real flags of one column of it."""
    if column is None:
        mask = F.transform("past", lambda r: F.lit(1))
    else:
        mask = F.transform("past", lambda r: r[column].isNotNull().cast("int"))
    return windows.withColumn("past_observed_mask", mask)


def window_mean_scale(windows: DataFrame, past: str = "past", future: str = "future") -> DataFrame:
    """Divide both parts by ``mean(past) + 1`` where that mean is positive.

    The divisor used (1 where nothing was divided) is kept for the inverse.
    """
    mean = arrays.array_mean(F.col(past))
    rows = windows.withColumn("mean", mean).withColumn("std", arrays.array_spread(F.col(past), ddof=1))
    rows = rows.withColumn(
        "divisor", F.when(F.col("mean") > 0, F.col("mean") + 1).otherwise(F.lit(1.0))
    )
    return rows.withColumns(
        {c: F.transform(c, lambda v: v / F.col("divisor")) for c in (past, future)}
    )


def window_mean_unscale(windows: DataFrame, cols: Sequence[str]) -> DataFrame:
    return windows.withColumns(
        {c: F.transform(c, lambda v: v * F.col("divisor")) for c in cols}
    )


def window_norm_params(windows: DataFrame, kind: str = "mean", past: str = "past") -> DataFrame:
    """``mean + 1`` or the sample deviation of every window's past."""
    x = F.col(past)
    v = arrays.array_mean(x) + 1 if kind == "mean" else arrays.array_spread(x, ddof=1)
    return windows.select(*[c for c in windows.columns if c not in ("past", "future")], v.alias("v"))


def window_standardise(windows: DataFrame, tiny: float = 1e-5) -> DataFrame:
    """Both parts by the mean and population deviation of the past."""
    rows = windows.withColumn("loc", arrays.array_mean(F.col("past"))).withColumn(
        "spread", F.greatest(arrays.array_spread(F.col("past")), F.lit(tiny))
    )
    return rows.withColumns(
        {c: F.transform(c, lambda v: (v - F.col("loc")) / F.col("spread")) for c in ("past", "future")}
    )


def zero_pad_front(
    df: DataFrame,
    keys: Sequence[str],
    min_length: int,
    cols: Sequence[str],
    ts: str = "ts",
    pos: str = "pos",
) -> DataFrame:
    """Prepend zero rows to series shorter than ``min_length`` and renumber from 0.

    Timestamps run backwards by the distance of the first two rows; a series of one row has
    no such distance and gets NULL timestamps.
    """
    shape = df.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min(F.when(F.col(pos) == 0, F.col(ts))).alias("_t0"),
        F.min(F.when(F.col(pos) == 1, F.col(ts))).alias("_t1"),
    )
    shape = settle(shape.withColumn("_need", F.greatest(F.lit(min_length) - F.col("_n"), F.lit(0))))
    short = shape.filter("_need > 0").withColumn("_back", F.explode(F.expr("sequence(1L, _need)")))
    stamp = (F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp")))
    zeros = {f.name: F.lit(0).cast(f.dataType) for f in df.schema.fields if f.name in cols}
    padding = short.select(
        *keys,
        F.timestamp_micros(
            F.unix_micros(F.col("_t0").cast("timestamp")) - F.col("_back") * stamp
        ).cast(df.schema[ts].dataType).alias(ts),
        (F.col("_need") - F.col("_back")).alias(pos),
        *[zeros[c].alias(c) for c in cols],
        F.lit(True).alias("padded"),
    )
    kept = attach(df, shape.select(*keys, "_need"), keys).select(
        *keys, ts, (F.col(pos) + F.col("_need")).alias(pos), *cols, F.lit(False).alias("padded")
    )
    return padding.unionByName(kept)


def single_step_expand(
    windows: DataFrame, values: str, pred: int, covariates: Sequence[str] = ()
) -> DataFrame:
    """``pred`` sub-windows per window, the last slot masked and its true value as label.

    ``covariates`` are arrays as long as ``values``; they are cut at the same places. A window of
    fewer than ``pred`` values is one row with NULL ``step`` and ``label`` and its arrays as they are.
    """
    length = F.size(values) - F.lit(pred - 1)
    steps = F.when(F.size(values) >= pred, F.sequence(F.lit(0), F.lit(pred - 1)))
    rows = windows.withColumn("step", F.explode_outer(steps))
    whole = F.col("step").isNull()
    at = F.coalesce("step", F.lit(0))
    size = F.greatest(length, F.lit(1))
    cut = {c: F.when(whole, F.col(c)).otherwise(F.slice(c, at + 1, size)) for c in covariates}
    label = F.when(~whole, F.try_element_at(values, at + size))
    masked = F.when(whole, F.col(values)).otherwise(arrays.masked_subwindow(F.col(values), at, size))
    return rows.withColumn("label", label).withColumns({**cut, values: masked})


def append_predict_token(
    windows: DataFrame, past: str = "past", past_marks: str | None = None, future_marks: str | None = None
) -> DataFrame:
    """One more step at the end of the context: value 0 with the first future covariates."""
    out = windows.withColumn(past, arrays.with_predict_token(F.col(past)))
    if past_marks is not None:
        out = out.withColumn(past_marks, F.concat(past_marks, F.slice(future_marks, 1, 1)))
    return out


def patching(windows: DataFrame, length: int, column: str = "past", name: str = "patch") -> DataFrame:
    """One row per patch: ``patch_id`` and the patch's values."""
    return windows.select(
        *[c for c in windows.columns if c != column],
        F.posexplode(arrays.patches(F.col(column), length)).alias("patch_id", name),
    )


def pyramid_levels(
    df: DataFrame,
    keys: Sequence[str],
    window_sizes: Sequence[int] = (4, 4, 4),
    value: str = "value",
    pos: str = "pos",
) -> DataFrame:
    """The series and its coarser copies, averaged and by maximum: ``keys, level, idx, mean, peak``.

    A coarse row covers the product of the window sizes up to its level; groups that are not
    full are dropped. Each level is made from the sums, counts and maxima of the one below and
    written: one shuffle per level, of rows that become fewer by the window size each time. The
    base rows are handed through without one.
    """
    base = df.select(*keys, F.col(pos).cast("bigint").alias("idx"), F.col(value).alias("_peak"))
    base = base.select(*keys, "idx", F.col("_peak").cast("double").alias("_sum"), F.col("_peak").isNotNull().cast("bigint").alias("_n"), "_peak")
    levels, below = [base.withColumn("level", F.lit(0))], base
    for level, size in enumerate(window_sizes, start=1):
        group = F.floor(F.col("idx") / F.lit(size)).cast("bigint").alias("idx")
        pooled = below.groupBy(*keys, group).agg(
            F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.max("_peak").alias("_peak"), F.count("*").alias("_full")
        )
        below = settle(pooled.filter(F.col("_full") == size).drop("_full"))
        levels.append(below.withColumn("level", F.lit(level)))
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    return out.select(*keys, "level", "idx", F.try_divide("_sum", "_n").alias("mean"), F.col("_peak").alias("peak"))


def pyramid_pool(
    df: DataFrame,
    keys: Sequence[str],
    window_sizes: Sequence[int] = (4, 4, 4),
    how: str = "mean",
    value: str = "value",
    pos: str = "pos",
) -> DataFrame:
    """One kind of ``pyramid_levels``: ``keys, level, idx, value``."""
    rows = pyramid_levels(df, keys, window_sizes, value, pos)
    return rows.select(*keys, "level", "idx", F.col("mean" if how == "mean" else "peak").alias(value))


def pyramid_gather(
    pyramid: DataFrame,
    keys: Sequence[str],
    window_sizes: Sequence[int] = (4, 4, 4),
    value: str = "value",
) -> DataFrame:
    """Each base row with its ancestor's value at every level (``value_0``, ``value_1``, …).

    The ancestor of row ``i`` one level up is ``min(i // w, size - 1)``. Levels are joined
    from the coarsest down, so the base rows are joined once, on ``i // w`` alone: where a level
    ends early, its last row is copied to the places that are asked for behind it. The pyramid
    is written first: every level is a filter on it.
    """
    pyramid = settle(pyramid)
    depth = range(len(window_sizes) + 1)
    ends = pyramid.groupBy(*keys).agg(*[F.max(F.when(F.col("level") == level, F.col("idx"))).alias(f"_end_{level}") for level in depth])
    ends = settle(ends)

    def above(idx: str, level: int) -> Column:
        return F.floor(F.col(idx) / F.lit(window_sizes[level])).cast("bigint")

    def asked_behind(level: int) -> DataFrame:
        """``keys, _own, _idx``: the last place of a level and those behind it that the level below asks for."""
        behind = ends.select(*keys, F.col(f"_end_{level}").alias("_own"), above(f"_end_{level - 1}", level - 1).alias("_last"))
        behind = behind.filter(F.col("_last") > F.col("_own"))
        near = F.col("_last") - F.col("_own") <= STAND_INS
        asked = behind.filter(near).select(*keys, "_own", F.explode(F.sequence(F.col("_own") + 1, F.col("_last"))).alias("_idx"))
        far = behind.filter(~near).drop("_last")
        if far.isEmpty():
            return asked
        # Far behind there may be holes: only the places that rows lie under.
        below = pyramid.filter(F.col("level") == level - 1).select(*keys, above("idx", level - 1).alias("_idx"))
        below = attach(below, far, keys).filter(F.col("_idx") > F.col("_own"))
        return asked.unionByName(below.select(*keys, "_own", "_idx").distinct())

    def level_rows(level: int) -> DataFrame:
        rows = pyramid.filter(F.col("level") == level).select(*keys, F.col("idx").alias("_own"), F.col(value).alias(f"value_{level}"))
        placed = rows.withColumn("_idx", F.col("_own"))
        if level:
            placed = placed.unionByName(rows.join(asked_behind(level), [*keys, "_own"]))
        return placed.withColumnRenamed("_idx", f"_idx_{level}")

    top = len(window_sizes)
    gathered = level_rows(top).drop("_own")
    for level in range(top - 1, -1, -1):
        rows = level_rows(level).withColumn(f"_idx_{level + 1}", above("_own", level)).drop("_own")
        gathered = rows.join(gathered, [*keys, f"_idx_{level + 1}"], "left").drop(f"_idx_{level + 1}")
    return gathered.select(*keys, F.col("_idx_0").alias("idx"), *[f"value_{level}" for level in depth])


def future_index(
    df: DataFrame, keys: Sequence[str], steps: int, period: timedelta, ts: str = "ts"
) -> DataFrame:
    """``steps`` timestamps after the last one of every series."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    rows = spread(last, keys).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return rows.select(*keys, "step", shift(F.col("_last"), F.col("step"), period).alias(ts))


def window_lengths(df: DataFrame, keys: Sequence[str], context: int, horizon: int, stride: int = 1) -> DataFrame:
    """How many windows each series yields: ``(n - context - horizon) // stride + 1``."""
    n = series_length(df, keys)
    room = F.col("n_rows") - (context + horizon)
    count = F.when(room >= 0, F.floor(room / F.lit(stride)) + 1).otherwise(F.lit(0))
    return n.withColumn("n_windows", count)
