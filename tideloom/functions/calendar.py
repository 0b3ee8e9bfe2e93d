"""Calendar and position features as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(value: Column, span: int, first: int = 0) -> Column:
    """``(value - first) / span - 0.5``."""
    shifted = value - first if first else value
    return shifted.cast("double") / F.lit(float(span)) - F.lit(0.5)


def calendar_raw(ts: Column) -> dict[str, Column]:
    return {
        "day_of_week": F.weekday(ts).cast("float"),
        "day_of_month": F.dayofmonth(ts).cast("float"),
        "month": F.month(ts).cast("float"),
        "hour": F.hour(ts).cast("float"),
    }


def calendar_norm(ts: Column) -> dict[str, Column]:
    """Eight features in [-0.5, 0.5]."""
    return {
        "second_of_minute": _unit(F.second(ts), 59),
        "minute_of_hour": _unit(F.minute(ts), 59),
        "hour_of_day": _unit(F.hour(ts), 23),
        "day_of_week": _unit(F.weekday(ts), 6),
        "day_of_month": _unit(F.dayofmonth(ts), 30, first=1),
        "day_of_year": _unit(F.dayofyear(ts), 365, first=1),
        "month_of_year": _unit(F.month(ts), 11, first=1),
        "week_of_year": _unit(F.weekofyear(ts), 52, first=1),
    }


# Features used at each sampling frequency, in output order.
DAILY = ["day_of_week", "day_of_month", "day_of_year"]
FEATURES_BY_FREQUENCY = {
    "year": [],
    "quarter": ["month_of_year"],
    "month": ["month_of_year"],
    "week": ["day_of_month", "week_of_year"],
    "day": DAILY,
    "business day": DAILY,
    "hour": ["hour_of_day", *DAILY],
    "minute": ["minute_of_hour", "hour_of_day", *DAILY],
    "second": ["second_of_minute", "minute_of_hour", "hour_of_day", *DAILY],
}

# Frequency letters.
FREQUENCY_LETTERS = {
    "year": ["Y", "YE", "A"],
    "quarter": ["Q", "QE"],
    "month": ["M", "ME"],
    "week": ["W"],
    "day": ["D"],
    "business day": ["B"],
    "hour": ["H", "h"],
    "minute": ["T", "t", "min"],
    "second": ["S", "s"],
}


def frequency_name(freq: str) -> str:
    """``'12H'`` → ``'hour'``; week and year ends may carry an anchor (``'W-SUN'``)."""
    match = re.fullmatch(r"\d*([A-Za-z]+)(?:-[A-Z]{3})?", freq)
    for name, letters in FREQUENCY_LETTERS.items():
        if match and match.group(1) in letters:
            return name
    known = ", ".join(letters[0] for letters in FREQUENCY_LETTERS.values())
    raise ValueError(f"unsupported frequency {freq!r}; use a multiple of one of {known}")


def calendar_by_freq(ts: Column, freq: str) -> dict[str, Column]:
    features = calendar_norm(ts)
    return {name: features[name] for name in FEATURES_BY_FREQUENCY[frequency_name(freq)]}


# Integer features for each frequency letter.
INTEGER_FEATURES = {
    "y": [],
    "m": ["month"],
    "w": ["month"],
    "d": ["month", "day", "weekday"],
    "b": ["month", "day", "weekday"],
    "h": ["month", "day", "weekday", "hour"],
    "t": ["month", "day", "weekday", "hour", "minute"],
}


def calendar_int(ts: Column, freq: str = "h") -> dict[str, Column]:
    """Integer features; ``minute`` counts quarter hours."""
    every = {
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "weekday": F.weekday(ts),
        "hour": F.hour(ts),
        "minute": F.floor(F.minute(ts) / F.lit(15)).cast("int"),
    }
    return {name: every[name] for name in INTEGER_FEATURES[freq.lower()]}


def calendar_fraction(ts: Column) -> dict[str, Column]:
    return {
        "weekday": F.weekday(ts) / F.lit(7.0),
        "hour": F.hour(ts) / F.lit(24.0),
        "month": F.month(ts) / F.lit(12.0),
    }


def calendar_cyclic(ts: Column) -> dict[str, Column]:
    """Cosine and sine of year/365, month/12, day/31 and weekday/7 turns."""
    turns = {
        "year": F.year(ts) / F.lit(365.0),
        "month": F.month(ts) / F.lit(12.0),
        "day": F.dayofmonth(ts) / F.lit(31.0),
        "weekday": F.weekday(ts) / F.lit(7.0),
    }
    out = {}
    for name, turn in turns.items():
        angle = F.lit(2.0) * F.pi() * turn
        out[f"{name}_cos"] = F.cos(angle)
        out[f"{name}_sin"] = F.sin(angle)
    return out


def position_sinusoid(pos: Column, dims: int) -> Column:
    """Array of ``dims`` values: sine at even and cosine at odd places."""

    def entry(i: Column) -> Column:
        pair = F.floor(i / F.lit(2)).cast("double")
        angle = pos / F.pow(F.lit(10000.0), pair * F.lit(2.0) / F.lit(float(dims)))
        return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), entry)
