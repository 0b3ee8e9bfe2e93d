"""The training table: cleaned channels, calendar, scaling, lags and rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.functions.calendar import calendar_raw
from tideloom.operators.filters import iqr_filter
from tideloom.operators.ordering import CHUNK, compact_position, keep_first, with_length
from tideloom.operators.rolling import fill, fill_head, first_present, row_features
from tideloom.operators.scaling import fit_robust, scale
from tideloom.operators.splits import fraction, three_way_label
from tideloom.session import settle


def feature_names(cols: Sequence[str]) -> list[str]:
    """Channels and calendar columns, each followed later by its lag and rolling columns."""
    base = [*cols, *calendar_raw(F.lit(None).cast("timestamp_ntz"))]
    derived = [f"{c}_{kind}" for c in base for kind in ("lag1", "rolling_mean", "rolling_std")]
    return [*base, *derived]


def feature_matrix(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "ts",
    pos: str = "pos",
    train: float = 0.7,
    valid: float = 0.2,
    width: int = 5,
    chunk: int = CHUNK,
) -> DataFrame:
    """Outlier filter, gap fill, calendar, robust scaling fit on the first rows, lag and
    rolling columns, gap fill and the three-way split.

    Rows are renumbered after the filter, so lags and rolling frames run over the rows that
    are left even where time has a gap. The quartiles of the filter see all rows, the scaler
    sees the training rows. With ``c`` channels there are ``4 * (c + 4)`` feature columns.
    """
    kept = iqr_filter(df.select(*keys, ts, pos, *cols), cols, keys)
    kept = settle(compact_position(kept, keys, pos, chunk))
    rows = settle(with_length(fill(kept, cols, keys, pos, chunk), keys))
    calendar = {name: c.cast("double") for name, c in calendar_raw(F.col(ts)).items()}
    rows = rows.withColumns(calendar)
    base = [*cols, *calendar]
    fitted = fit_robust(rows.filter(F.col(pos) < fraction(F.col("n_rows"), train)), base, keys)
    scaled = scale(rows, fitted, base, keys)
    derived = [c for c in feature_names(cols) if c not in base]
    # Only the first rows of a series lack a lag or a full frame, so only they are needed to
    # find what those rows are filled with.
    head = row_features(keep_first(scaled, width, pos), base, keys, width, pos, chunk)
    firsts = first_present(head, derived, keys, pos)
    featured = row_features(scaled, base, keys, width, pos, chunk)
    out = fill_head(featured, derived, keys, pos, firsts)
    return out.withColumn("split", three_way_label(F.col(pos), F.col("n_rows"), train, valid)).drop("n_rows")
