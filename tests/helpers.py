"""Small series made with a fixed seed, and pandas views of results."""

from __future__ import annotations

import numpy as np
import pandas as pd

START = pd.Timestamp("2024-01-01")


def long_frame(series: dict[str, np.ndarray], freq: str = "h") -> pd.DataFrame:
    parts = []
    for name, values in series.items():
        n = len(values)
        parts.append(
            pd.DataFrame(
                {
                    "series_id": name,
                    "pos": np.arange(n),
                    "ts": pd.date_range(START, periods=n, freq=freq),
                    "value": np.asarray(values, dtype=float),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, frame: pd.DataFrame, partitions: int = 4, seed: int = 1):
    """Shuffled rows in several partitions; NaN becomes NULL and time is naive."""
    shuffled = frame.sample(frac=1, random_state=seed)
    rows = [
        tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row)
        for row in shuffled.astype(object).itertuples(index=False)
    ]
    kinds = {"series_id": "string", "pos": "bigint", "ts": "timestamp_ntz", "row_id": "bigint"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in frame.columns)
    return spark.createDataFrame(rows, schema).repartition(partitions)


def collected(df, by=("series_id", "pos")) -> pd.DataFrame:
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def gappy(n: int, seed: int, share: float = 0.4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    values = rng.normal(size=n)
    values[rng.random(n) < share] = np.nan
    return values


def arma(n: int, phi: float = 0.0, theta: float = 0.0, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=n + 100)
    out = np.zeros(n + 100)
    for t in range(1, n + 100):
        out[t] = phi * out[t - 1] + noise[t] + theta * noise[t - 1]
    return out[100:]
