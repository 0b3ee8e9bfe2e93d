"""Microsecond arithmetic on naive timestamps."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def period_micros(period: timedelta) -> int:
    micros = period // timedelta(microseconds=1)
    if micros <= 0:
        raise ValueError("a period must be positive")
    return micros


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def shift(ts: Column, steps: Column, period: timedelta) -> Column:
    return from_micros(micros(ts) + steps * F.lit(period_micros(period)))


def steps_between(start: Column, end: Column, period: timedelta) -> Column:
    """Whole periods from ``start`` to ``end`` (floor)."""
    return F.floor((micros(end) - micros(start)) / F.lit(period_micros(period))).cast("bigint")


def bin_start(ts: Column, period: timedelta, closed: str = "right") -> Column:
    """Left label of the bin that holds ``ts``.

    With ``closed='right'`` a timestamp that sits exactly on an edge belongs to the bin
    before it.
    """
    width = F.lit(period_micros(period))
    us = micros(ts) - 1 if closed == "right" else micros(ts)
    return from_micros(us - F.pmod(us, width))
