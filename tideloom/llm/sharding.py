"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.llm.registry import packed, register, table
from tideloom.session import settle

#: Places on the ring at which keys may lie; the driver sees one sum per place.
PLACES = 1 << 14
#: Virtual nodes of a shard.
NODES = 256
#: Load above the mean at which a shard is full.
SLACK = 0.001
#: Groups of equal texts above this share of a shard's mean load are dealt one by one.
LARGE = 0.01
#: Cells of ids: a hot group is divided, and rows are numbered, by them.
CELLS = 1 << 12


@dataclass(frozen=True)
class Ring:
    """Virtual nodes of the shards on ``places`` points; shards are named by number."""

    shards: int
    places: int = PLACES
    nodes: int = NODES

    def walk(self) -> tuple[list[int], list[int]]:
        """Positions of all virtual nodes, sorted, and their shards. Positions are fractions of the ring."""
        spots = []
        for shard in range(self.shards):
            for node in range(self.nodes):
                digest = blake2b(f"{shard}:{node}".encode(), digest_size=8).digest()
                spots.append((int.from_bytes(digest, "big"), shard))
        spots.sort()
        return [p for p, _ in spots], [s for _, s in spots]

    def deal(self, loads: dict[int, int], slack: float = SLACK) -> list[tuple[int, int, int, int]]:
        """``(place, shard, from, to)``: ``deal_groups`` without large groups."""
        return self.deal_groups(loads, {}, slack)[0]

    def deal_groups(
        self, loads: dict[int, int], groups: dict[int, tuple[int, int]], slack: float = SLACK
    ) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
        """``(place, shard, from, to)`` and ``(group, shard, from, to)``: which bytes go to which shard.

        ``groups`` gives large groups a place and a load each. They come first, the largest ahead: each
        goes whole to the first shard clockwise that has room for it, and is divided only if none
        has. Places follow in a hashed order that does not depend on the shards; each goes
        clockwise to the first shard that is not full, and what overflows it continues clockwise.
        """
        positions, owners = self.walk()
        full = math.ceil((1 + slack) * (sum(loads.values()) + sum(load for _, load in groups.values())) / self.shards)
        held = [0] * self.shards

        def clockwise(place: int) -> list[int]:
            at = bisect_left(positions, (place << 64) // self.places)
            return list(dict.fromkeys(owners[at:] + owners[:at]))

        def pour(name: int, place: int, load: int) -> list[tuple[int, int, int, int]]:
            out, done = [], 0
            for shard in clockwise(place):
                part = min(full - held[shard], load - done)
                if part > 0:
                    held[shard] += part
                    out.append((name, shard, done, done + part))
                    done += part
                if done >= load:
                    break
            assert done == load, f"{name}: {done} of {load} bytes dealt"
            return out

        dealt = []
        for name, (place, load) in sorted(groups.items(), key=lambda g: (-g[1][1], g[0])):
            roomy = [s for s in clockwise(place) if full - held[s] >= load][:1]
            for shard in roomy:
                held[shard] += load
                dealt.append((name, shard, 0, load))
            if not roomy:
                dealt += pour(name, place, load)
        order = sorted(loads, key=lambda p: blake2b(f"p{p}".encode(), digest_size=8).digest())
        return [part for place in order for part in pour(place, place, loads[place])], dealt


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: Sequence[str] = (),
    ring: Ring | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``_kept`` (a struct of the ``keep`` columns), ``_doc_id, _size,
    _text_crc32, _shard, _slot``.

    The law is ``bytes``: the sizes of the shards (UTF-8 bytes of the text, null being none, plus
    one per row) are near equal. A row's place on the ring is a hash of its text, so equal texts
    lie together. The driver receives the load of every place, at most ``PLACES`` sums, and of every
    group of equal texts above ``LARGE`` of a shard, of which there are ``shards / LARGE`` at
    most, and deals them out (``Ring.deal_groups``): no shard takes more than ``1 + SLACK`` times the mean,
    plus the rows or the one small group that straddle a limit, and only what overflows a full
    shard moves on. A place that has to be divided is cut between groups of equal texts. A large
    group is divided, by cells of a hash of ids, only if no shard has room for the whole; a text that
    fills a third of the table is spread like any other load.

    ``_slot`` numbers a shard's rows without gaps from 0: rows are numbered within the cells of a
    shard, whose first numbers come from the counts of the cells, so no shard is sorted in one
    task. Rows that repeat an id share a cell; a null id has a cell of its own. Null and empty
    texts have size 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ring = ring or Ring(shards)
    text, ids = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    rows = docs.select(
        *packed(keep),
        ids.alias("_doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        F.crc32(text.cast("binary")).alias("_text_crc32"),
        F.xxhash64(text).alias("_text"),
        F.pmod(F.xxhash64(ids, text, F.lit(17)), F.lit(CELLS)).cast("long").alias("_cell"),
    ).withColumn("_place", F.pmod("_text", F.lit(ring.places)).cast("long"))
    slim = settle(rows.drop("_kept"))
    rows = rows if keep else slim
    total = slim.agg(F.sum("_size")).first()[0] or 0
    sizes = slim.groupBy("_text", "_place").agg(F.sum("_size").alias("load"))
    large = settle(sizes.where(F.col("load") > int(LARGE * total / ring.shards)))
    groups = {r["_text"]: (r["_place"], r["load"]) for r in large.collect()}
    marks = F.broadcast(large.select("_text", F.lit(True).alias("_large")))

    def units(df: DataFrame) -> DataFrame:
        """What is dealt as one, a large group or a place, and the parts it may be cut into."""
        marked = df.join(marks, "_text", "left").withColumn("_large", F.coalesce("_large", F.lit(False)))
        return marked.withColumns(
            {
                "_unit": F.when(F.col("_large"), F.col("_text")).otherwise(F.col("_place")),
                "_part": F.when(F.col("_large"), F.col("_cell")).otherwise(F.col("_text")),
            }
        )

    small = units(slim).where("NOT _large").groupBy("_place").agg(F.sum("_size").alias("load"))
    places, dealt = ring.deal_groups({r["_place"]: r["load"] for r in small.collect()}, groups)
    every = [(False, *d) for d in places] + [(True, *d) for d in dealt]
    times = Counter(d[:2] for d in every)
    schema = "_large boolean, _unit long, _shard int, _from long, _until long"
    plain = spark.createDataFrame([d for d in every if times[d[:2]] == 1], schema).drop("_from", "_until")
    cut = spark.createDataFrame([d for d in every if times[d[:2]] > 1], schema)
    divided = F.broadcast(cut.select("_large", "_unit").distinct())
    # Divided units: parts in the order of their hash; one goes where its middle lies.
    unit = ["_large", "_unit"]
    pieces = units(slim).join(divided, unit, "left_semi").groupBy(*unit, "_part").agg(F.sum("_size").alias("load"))
    order = Window.partitionBy(*unit).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_mid", F.coalesce(F.sum("load").over(order), F.lit(0)) + F.col("load") / 2)
    pieces = pieces.join(F.broadcast(cut), unit).where("_mid >= _from AND _mid < _until")
    pieces = settle(pieces.select(*unit, "_part", "_shard"))
    named = units(rows)
    whole = named.join(F.broadcast(plain), unit)
    moved = named.join(divided, unit, "left_semi").join(pieces, [*unit, "_part"])
    return _numbered(whole.unionByName(moved).drop("_place", "_text", "_part", *unit))


def _numbered(placed: DataFrame) -> DataFrame:
    placed = settle(placed)
    counts = placed.groupBy("_shard", "_cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_shard", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_shard", "_cell").orderBy("_doc_id", "_text_crc32", "_size"))
    slot: Column = (F.col("_first") + within - 1).cast("long")
    numbered = placed.join(first, ["_shard", "_cell"]).withColumn("_slot", slot)
    kept = [c for c in placed.columns if c == "_kept"]
    return numbered.select(*kept, "_doc_id", "_size", "_text_crc32", "_shard", "_slot")


@register("op3_shard")
def op3_shard(spark, sf_dir):
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_text_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
