"""Train / validation / test splits.

Every split needs each row's position ``pos`` and the series length; rows are labelled with
a ``split`` column. Splits that overlap return a row once per split it belongs to.
Fractions truncate as binary floating point does: ``int(n * 0.7)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.operators.ordering import attach, with_length

# Days per month and the train / validation / test months of the calendar split.
MONTH_DAYS = 30
CALENDAR_MONTHS = (12, 4, 4)


def fraction(n: Column, share: float) -> Column:
    return F.floor(n.cast("double") * F.lit(float(share))).cast("bigint")


def split_train_test(
    df: DataFrame, keys: Sequence[str], share: float = 0.8, pos: str = "pos"
) -> DataFrame:
    rows = with_length(df, keys)
    is_train = F.col(pos) < fraction(F.col("n_rows"), share)
    return rows.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("n_rows")


def three_way_label(pos: Column, n: Column, train: float, valid: float) -> Column:
    n_train, n_valid = fraction(n, train), fraction(n, valid)
    label = F.when(pos < n_train, "train").when(pos < n_train + n_valid, "valid")
    return label.otherwise("test")


def split_three_way(
    df: DataFrame,
    keys: Sequence[str],
    train: float = 0.7,
    valid: float = 0.2,
    pos: str = "pos",
) -> DataFrame:
    rows = with_length(df, keys)
    label = three_way_label(F.col(pos), F.col("n_rows"), train, valid)
    return rows.withColumn("split", label).drop("n_rows")


@dataclass(frozen=True)
class Span:
    """Positions ``[low, high)`` that make up one split."""

    name: str
    low: Column
    high: Column


def label_spans(df: DataFrame, spans: Sequence[Span], pos: str = "pos") -> DataFrame:
    """One output row for every span a row lies in; rows in no span are left out."""
    labels = [
        F.when((F.col(pos) >= s.low) & (F.col(pos) < s.high), F.lit(s.name)) for s in spans
    ]
    return df.withColumn("split", F.explode(F.array_compact(F.array(*labels))))


def split_overlap(
    df: DataFrame,
    keys: Sequence[str],
    context: int,
    train: float = 0.7,
    test: float = 0.2,
    pos: str = "pos",
) -> DataFrame:
    """Train, then validation, then test, the last two starting ``context`` rows early."""
    n = F.col("n_rows")
    n_train = fraction(n, train)
    valid_end = n - fraction(n, test)
    spans = [
        Span("train", F.lit(0), n_train),
        Span("valid", F.greatest(n_train - context, F.lit(0)), valid_end),
        Span("test", F.greatest(valid_end - context, F.lit(0)), n),
    ]
    return label_spans(with_length(df, keys), spans, pos).drop("n_rows")


def calendar_spans(
    seq_len: int,
    ticks_per_hour: int = 1,
    months: Sequence[int] = CALENDAR_MONTHS,
    month_days: int = MONTH_DAYS,
) -> list[Span]:
    month = month_days * 24 * ticks_per_hour
    ends, total = [], 0
    for m in months:
        total += m * month
        ends.append(total)
    starts = [0] + [max(e - seq_len, 0) for e in ends[:-1]]
    return [
        Span(name, F.lit(low), F.lit(high))
        for name, low, high in zip(("train", "valid", "test"), starts, ends)
    ]


def split_calendar(
    df: DataFrame,
    seq_len: int,
    ticks_per_hour: int = 1,
    months: Sequence[int] = CALENDAR_MONTHS,
    month_days: int = MONTH_DAYS,
    pos: str = "pos",
) -> DataFrame:
    """Borders after fixed numbers of 30-day months; later splits start ``seq_len`` early.

    ``ticks_per_hour`` is 1 for hourly and 4 for quarter-hour data.
    """
    return label_spans(df, calendar_spans(seq_len, ticks_per_hour, months, month_days), pos)


def split_by_date(
    df: DataFrame,
    train_until: str,
    seq_len: int,
    keys: Sequence[str],
    pos: str = "pos",
    ts: str = "ts",
) -> DataFrame:
    """Train ends with the last row up to a date; test starts ``seq_len - 1`` rows earlier.

    ``df`` holds the rows left after trimming, so counting them gives the trimmed border.
    """
    border = df.groupBy(*keys).agg(
        F.count(F.when(F.col(ts) <= F.lit(train_until).cast("timestamp_ntz"), 1)).alias("train_end")
    )
    spans = [
        Span("train", F.lit(0), F.col("train_end")),
        Span("test", F.greatest(F.col("train_end") - seq_len + 1, F.lit(0)), F.lit(2**62)),
    ]
    return label_spans(attach(df, border, keys), spans, pos)


def panel_tail_border(n: Column, share: float = 0.8, reserve: int = 1000) -> Column:
    """``min(int(share * n), n - reserve)``."""
    return F.least(fraction(n, share), n - reserve)


def window_count_border(
    n: Column, seq_len: int, pred_len: int, stride: int = 24, share: float = 0.9
) -> Column:
    """Train end after ``share`` of the windows that fit: ``seq + pred + int(share*w)*stride``."""
    windows = (n - seq_len - pred_len).cast("double") / F.lit(float(stride))
    taken = F.floor(F.lit(float(share)) * windows).cast("bigint")
    return F.lit(seq_len + pred_len) + taken * stride


def split_panel(
    df: DataFrame, keys: Sequence[str], border: Column, seq_len: int, pos: str = "pos"
) -> DataFrame:
    """Train up to ``border`` (an expression on ``n_rows``); test starts ``seq_len-1`` earlier."""
    rows = with_length(df, keys).withColumn("train_end", border)
    spans = [
        Span("train", F.lit(0), F.col("train_end")),
        Span("test", F.greatest(F.col("train_end") - seq_len + 1, F.lit(0)), F.col("n_rows")),
    ]
    return label_spans(rows, spans, pos).drop("n_rows")


__all__ = [
    "Span",
    "calendar_spans",
    "fraction",
    "label_spans",
    "panel_tail_border",
    "split_by_date",
    "split_calendar",
    "split_overlap",
    "split_panel",
    "split_three_way",
    "split_train_test",
    "three_way_label",
    "window_count_border",
]
