"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.session import settle


def _state(links: DataFrame) -> tuple:
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links (a, b)``: the smallest id it is linked with.

    Large stars and small stars alternate until nothing changes, in a number of rounds that is
    logarithmic in the longest path; each round is written, so a lost executor costs one round.
    The smallest neighbour is aggregated map-side and joined back, so a star's centre is never
    one task's work. Loops and repeated links are allowed.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = settle(links)
    before = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b")
        )
        links = settle(small.distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    centres = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(centres)
