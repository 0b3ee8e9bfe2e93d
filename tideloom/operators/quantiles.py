"""Exact linear-interpolated quantiles of any number of channels and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.operators.ordering import running_total
from tideloom.session import settle


def to_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Channels as rows: ``keys, channel, value`` (NULL and NaN left out)."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value"))
            for c in cols
        ]
    )
    long = df.select(*keys, F.explode(pairs).alias("_pair")).select(*keys, "_pair.*")
    return long.filter(F.col("value").isNotNull())


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """One row per ``keys, channel`` with a column per entry of ``probs``.

    Equal values are counted before anything is sorted, so a value that fills most of a
    channel is one row; the counts are then ranked by a range sort over the cluster. The
    built-in ``percentile`` would hold every distinct value of a channel in one task.
    """
    group = [*keys, "channel"]
    counts = to_long(df, keys, cols).groupBy(*group, "value").agg(F.count("*").alias("_count"))
    ranked = running_total(counts, group, ["value"], "_count", "_upto", whole="_size")

    def value_at(rank):
        return F.min(F.when(F.col("_upto") > rank, F.col("value")))

    picks = []
    for name, prob in probs.items():
        place = (F.col("_size") - 1) * F.lit(float(prob))
        picks += [
            value_at(F.floor(place)).alias(f"{name}_lo"),
            value_at(F.ceil(place)).alias(f"{name}_hi"),
            F.max(place - F.floor(place)).alias(f"{name}_part"),
        ]
    found = ranked.groupBy(*group).agg(*picks)
    # One short row per series and channel that callers use more than once.
    return settle(found.select(
        *group,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n)
            for n in probs
        ],
    ))


def by_channel(stats: DataFrame, cols: Sequence[str], names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, channel, stat…`` → one row per ``keys`` with columns ``<channel>__<stat>``."""
    picks = [
        F.max(F.when(F.col("channel") == c, F.col(n))).alias(f"{c}__{n}") for c in cols for n in names
    ]
    return stats.groupBy(*keys).agg(*picks)
