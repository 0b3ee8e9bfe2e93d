"""Column selection, type checks and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.operators.ordering import attach
from tideloom.operators.quantiles import by_channel, exact_quantiles


def parse_time(df: DataFrame, source: str, name: str = "ts", fmt: str | None = None) -> DataFrame:
    """Text to a naive timestamp; text that is no timestamp gives NULL."""
    args = [F.col(source)] if fmt is None else [F.col(source), F.lit(fmt)]
    return df.withColumn(name, F.try_to_timestamp(*args).cast("timestamp_ntz"))


def time_sort(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Order the output by series and time (a range sort; meant for sinks)."""
    return df.orderBy(*keys, *order)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def column_roles(
    df: DataFrame,
    time_column: str,
    target: str | None = None,
    features: Sequence[str] | None = None,
    index_start: int | None = None,
    numeric_only: bool = False,
) -> DataFrame:
    """Choose columns by role: the target with its features, or all from ``index_start`` on."""
    if target is not None:
        chosen = [target, *(features or [])]
    else:
        chosen = df.columns[1 if index_start is None else index_start :]
    chosen = [c for c in chosen if c != time_column]
    require_columns(df, [time_column, *chosen])
    if numeric_only:
        numeric = set(numeric_columns(df))
        chosen = [c for c in chosen if c in numeric]
    return df.select(time_column, *chosen)


def require_columns(df: DataFrame, columns: Sequence[str], **lengths: int) -> DataFrame:
    """Fail before any job runs when columns are missing or a length is not positive."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for name, value in lengths.items():
        if value <= 0:
            raise ValueError(f"{name} must be a positive integer, got {value}")
    return df


def numeric_cast(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Floating columns to FLOAT with missing as 0; integers pass; other types are refused."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, Column] = {}
    for c in cols:
        kind = fields[c]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out[c] = F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(0.0)).cast("float")
        elif not isinstance(kind, (T.IntegerType, T.LongType)):
            raise TypeError(f"column {c} has unsupported type {kind.simpleString()}")
    return df.withColumns(out) if out else df


def iqr_filter(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), whisker: float = 1.5
) -> DataFrame:
    """Drop a row when any channel lies outside ``[Q1 - w*IQR, Q3 + w*IQR]``.

    A missing value never drops its row.
    """
    quartiles = exact_quantiles(df, cols, {"q1": 0.25, "q3": 0.75}, keys)
    rows = attach(df, by_channel(quartiles, cols, ["q1", "q3"], keys), keys)
    inside = F.lit(True)
    for c in cols:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None))
        q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
        reach = (q3 - q1) * F.lit(whisker)
        inside = inside & F.coalesce(value.between(q1 - reach, q3 + reach), F.lit(True))
    return rows.filter(inside).select(*df.columns)


def date_slice(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows in ``[start, end]``, both ends included; the predicate reaches the scan."""
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    return df.filter(F.col(ts).between(low, high))
