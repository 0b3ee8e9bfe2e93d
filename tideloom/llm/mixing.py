"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.llm.registry import packed, register, table
from tideloom.session import settle

#: How often the mix may take one word, at a cost that grows by one with each repetition.
REPEATS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Membership patterns the driver may hold; more of them are an error, never a silent cut.
MAX_PATTERNS = 1_000_000
#: Digits of the seeded key that number the buckets of the selection: 16 ** 4 buckets.
_DIGITS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(
    sizes: Sequence[int], weights: Sequence[int], repeats: int = REPEATS, total: int | None = None
) -> list[float]:
    """Shares of the total (that of the sizes, unless documents have several sources) by weight, at most ``repeats`` times a size, the excess reshared by weight.

    Sources are capped in order of cap over weight; once one stays below its cap, so do the rest.
    """
    order = sorted(range(len(sizes)), key=lambda i: repeats * sizes[i] / weights[i])
    left, weight = sum(sizes) if total is None else total, sum(weights)
    out = [0.0] * len(sizes)
    for place, i in enumerate(order):
        level = left / weight
        if level * weights[i] <= repeats * sizes[i]:
            for j in order[place:]:
                out[j] = weights[j] * level
            break
        out[i] = float(repeats * sizes[i])
        left -= repeats * sizes[i]
        weight -= weights[i]
    return out


@dataclass
class _Edge:
    to: object
    room: int
    cost: int
    back: int


def _flow(supply: dict, quota: dict, repeats: int) -> dict:
    """Words each pattern gives to each of its sources: the cheapest way to fill most quotas.

    Source -> pattern edges, one per repetition, hold a pattern's words at costs 0, 1, 2, ...;
    pattern -> member edges are free; member -> sink edges hold the quotas. Successive shortest
    paths with potentials keep every augmentation cheapest.
    """
    graph: dict = defaultdict(list)

    def connect(a, b, room, cost):
        graph[a].append(_Edge(b, room, cost, len(graph[b])))
        graph[b].append(_Edge(a, 0, -cost, len(graph[a]) - 1))

    for pattern, words in supply.items():
        for k in range(repeats):
            connect("from", ("p", pattern), words, k)
        for member in pattern:
            connect(("p", pattern), ("s", member), repeats * words, 0)
    for member, words in quota.items():
        connect(("s", member), "to", words, 0)
    height = dict.fromkeys(graph, 0)
    while True:
        far, came, heap, turn = {"from": 0}, {}, [(0, 0, "from")], 0
        while heap:
            d, _, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for n, e in enumerate(graph[a]):
                reach = d + e.cost + height[a] - height[e.to]
                if e.room and reach < far.get(e.to, reach + 1):
                    far[e.to], came[e.to] = reach, (a, n)
                    turn += 1
                    heapq.heappush(heap, (reach, turn, e.to))
        if "to" not in far:
            break
        for a in graph:
            height[a] += far.get(a, far["to"])
        path, a = [], "to"
        while a != "from":
            path.append(came[a])
            a = came[a][0]
        amount = min(graph[b][n].room for b, n in path)
        for b, n in path:
            e = graph[b][n]
            e.room -= amount
            graph[e.to][e.back].room += amount
    given = defaultdict(dict)
    for pattern in supply:
        for e in graph[("p", pattern)]:
            if e.to != "from" and graph[e.to][e.back].room:
                given[pattern][e.to[1]] = graph[e.to][e.back].room
    return given


def route(supply: dict, quota: dict, repeats: int = REPEATS) -> dict:
    """``{pattern: {member: words}}``: the min-cost flow, solved apart for each connected part.

    A source that shares no document with another is a part with one pattern and one member.
    """
    of: dict = {}

    def root(s):
        while of[s] != s:
            of[s] = of[of[s]]
            s = of[s]
        return s

    for pattern in supply:
        for member in pattern:
            of.setdefault(member, member)
        for member in pattern[1:]:
            of[root(member)] = root(pattern[0])
    parts = defaultdict(list)
    for pattern in supply:
        parts[root(pattern[0])].append(pattern)
    given: dict = {}
    for patterns in parts.values():
        members = {m for p in patterns for m in p}
        given |= _flow({p: supply[p] for p in patterns}, {m: quota[m] for m in members}, repeats)
    return given


def mix_sources(
    docs: DataFrame,
    sources: Column | str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``_kept`` (a struct of the ``keep`` columns), ``_doc_id, _pattern, _size,
    _source_size, _target, _taken, _copies``.

    ``sources`` is a column or an array of all sources a document belongs to. Sources in code
    point order, null last, weigh ``weights``, repeating. ``targets`` gives each source its words;
    documents are counted by membership pattern, and a min-cost flow routes the patterns' words to
    the quotas, a further repetition of a word costing one more than the last. Patterns and
    sources are all the driver sees: one row each, at most ``MAX_PATTERNS``.

    A pattern that gives F words takes all its documents F // words times, and the rest from the
    documents in the order of a seeded hash of their ids: whole ones, and of the last a part.
    ``_taken`` counts words with that part; ``_copies`` is the number of whole copies, the last
    rounded. ``_target`` and ``_source_size`` are sums over a document's sources.

    The place where the last selection ends is found from sums by 65,536 buckets of the hash, then
    by key within one bucket per pattern; rows decide for themselves by comparing their key with
    that place, so no source is ever sorted. Reruns agree, as no order but that of the hash counts.

    A null text, or one without words, has size 0 and is never taken; a source with no words has
    target 0. An empty membership array counts as a null source. Rows that repeat an id share a
    key: at the end place they are taken in proportion to their sizes.
    """
    spark = docs.sparkSession
    of = F.col(sources) if isinstance(sources, str) else sources
    if not isinstance(docs.select(of.alias("s")).schema[0].dataType, T.ArrayType):
        of = F.array(of.cast("string"))
    of = F.array_sort(F.array_distinct(of.cast("array<string>")))
    of = F.when(F.size(of) > 0, of).otherwise(F.array(F.lit(None).cast("string")))
    ids = F.col(id_col)
    rows = docs.select(
        *packed(keep),
        ids.alias("_doc_id"),
        F.to_json(of).alias("_pattern"),
        word_count(F.col(text_col)).alias("_size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), ids.cast("string"))).alias("_key"),
    )
    slim = settle(rows.drop("_kept"))
    rows = rows if keep else slim
    totals = slim.groupBy("_pattern").agg(F.sum("_size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    supply = {tuple(json.loads(r["_pattern"])): r["words"] for r in totals}
    size: dict = defaultdict(int)
    for pattern, words in supply.items():
        for member in pattern:
            size[member] += words
    names = sorted(size, key=lambda s: (s is None, s or ""))
    repeating = [weights[i % len(weights)] for i in range(len(names))]
    wanted = dict(zip(names, targets([size[n] for n in names], repeating, repeats, sum(supply.values()))))
    given = route(supply, {n: int(w + 0.5) for n, w in wanted.items()}, repeats)
    plan = []
    for r in totals:
        pattern = tuple(json.loads(r["_pattern"]))
        flow = sum(given.get(pattern, {}).values())
        passes, rest = divmod(flow, r["words"]) if r["words"] else (0, 0)
        own, goal = sum(size[m] for m in pattern), float(sum(wanted[m] for m in pattern))
        plan.append((r["_pattern"], passes, rest, own, goal))
    plan = spark.createDataFrame(
        plan, "_pattern string, _passes long, _rest long, _source_size long, _target double"
    )
    # The key at which the last, partial pass of a pattern ends.
    bucket = F.substring("_key", 1, _DIGITS)

    def before(by: str) -> Column:
        upto = Window.partitionBy("_pattern").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("words").over(upto), F.lit(0))

    buckets = slim.groupBy("_pattern", bucket.alias("_at")).agg(F.sum("_size").alias("words"))
    ends = buckets.withColumn("_before", before("_at")).join(plan, "_pattern")
    ends = ends.where("_rest > _before AND _rest <= _before + words")
    ends = ends.select("_pattern", "_at", F.expr("_rest - _before").alias("_more"))
    close = slim.withColumn("_at", bucket).join(ends, ["_pattern", "_at"])
    close = close.groupBy("_pattern", "_more", "_key").agg(F.sum("_size").alias("words"))
    close = close.withColumn("_before", before("_key")).where("_more > _before AND _more <= _before + words")
    close = close.select(
        "_pattern", F.col("_key").alias("_end"), F.expr("_more - _before").alias("_part"), F.col("words").alias("_whole")
    )
    plan = settle(plan.join(close, "_pattern", "left"))
    inside, at_end = F.col("_key") < F.col("_end"), F.col("_key") == F.col("_end")
    last = F.when(inside, F.col("_size")).when(at_end, F.floor(F.col("_size") * F.col("_part") / F.col("_whole")))
    whole = inside | (at_end & (F.col("_part") * 2 >= F.col("_whole")))
    return rows.join(plan, "_pattern").select(
        *(["_kept"] if keep else []),
        "_doc_id",
        "_pattern",
        "_size",
        "_source_size",
        "_target",
        (F.col("_passes") * F.col("_size") + F.coalesce(last, F.lit(0))).cast("long").alias("_taken"),
        F.when(F.col("_size") == 0, 0)
        .otherwise(F.col("_passes") + F.coalesce(whole.cast("int"), F.lit(0)))
        .cast("int")
        .alias("_copies"),
    )


@register(
    "op2_mix_sources",
    r"""
    WITH d AS (
        SELECT doc_id, source, md5('0:' || CAST(doc_id AS VARCHAR)) AS key,
            coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
        FROM documents
    ), s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
            [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
        FROM d GROUP BY source
    ), o AS (
        SELECT *,
            row_number() OVER w AS place,
            CAST(sum(source_size) OVER () AS BIGINT)
                - 3 * CAST(coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
            CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS others
        FROM s WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST)
    ), l AS (
        SELECT *, CAST(rest AS DOUBLE) / others AS level,
            min(CASE WHEN CAST(rest AS DOUBLE) / others * weight <= 3 * source_size THEN place END) OVER () AS free
        FROM o
    ), t AS (
        SELECT source, source_size,
            CASE WHEN free IS NULL OR place < free THEN CAST(3 * source_size AS DOUBLE)
                ELSE weight * max(CASE WHEN place = free THEN level END) OVER () END AS target
        FROM l
    ), p AS (
        SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS words FROM t
    ), q AS (
        SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END AS passes,
            CASE WHEN source_size = 0 THEN 0 ELSE words % source_size END AS part FROM p
    ), k AS (
        SELECT source, key, sum(size) AS whole,
            coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY key
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d GROUP BY source, key
    )
    SELECT doc_id, size, source_size, target,
        CAST(passes * size + CASE WHEN whole = 0 OR part <= before THEN 0
            WHEN part >= before + whole THEN size
            ELSE floor(CAST(size * (part - before) AS DOUBLE) / whole) END AS BIGINT) AS taken
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
        JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
    """,
)
def op2_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )
