"""Near duplicates by a multi-index Hamming join of MinHash signatures, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.components import components
from tideloom.llm.registry import register, table
from tideloom.llm.textual import constants, mix, shingles, words_of
from tideloom.session import settle


@dataclass(frozen=True)
class Signature:
    """``chunks * width`` values of ``bits`` bits; up to ``errors`` values of a chunk may differ.

    Two signatures that differ in fewer than ``chunks * (errors + 1)`` values have, by the
    pigeonhole principle, a chunk with at most ``errors`` differences, and then agree on a key:
    every chunk gives one key for each way to leave out ``errors`` of its values.
    """

    chunks: int = 8
    width: int = 5
    errors: int = 1
    bits: int = 16
    seed: int = 1

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        n = self.chunks * self.width
        factors, offsets = constants(n, self.seed), constants(n, self.seed + 1)
        out = np.zeros((len(sets), n), np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                parts = range(0, len(s), 4096)
                lows = [(s[p : p + 4096, None] * factors + offsets).min(axis=0) for p in parts]
                out[i] = np.minimum.reduce(lows)
        return mix(out) & np.uint64((1 << self.bits) - 1)

    def keys(self, values: np.ndarray) -> np.ndarray:
        chunks = values.reshape(len(values), self.chunks, self.width)
        terms = mix(chunks * constants(self.width, self.seed + 2))
        kept = [[j not in left_out for j in range(self.width)] for left_out in combinations(range(self.width), self.errors)]
        sums = np.stack([terms[:, :, mask].sum(axis=2) for mask in np.array(kept)], axis=2)
        tags = constants(sums.shape[1] * sums.shape[2], self.seed + 3).reshape(sums.shape[1:])
        return mix(sums + tags).reshape(len(values), -1).view(np.int64)


#: Documents of a family that one task compares; larger families are dealt out in blocks.
BLOCK = 384
#: How many documents are sketched at once.
_SKETCHED = 256
#: Roles of a row in a comparison: compared with all rows, found by queries only, or a query.
_BOTH, _BASE, _QUERY = 0, 1, 2


def set_id(s: np.ndarray) -> int:
    """A 64-bit identity of a set of shingles."""
    total = np.array([mix(s).sum(dtype=np.uint64)])
    return int(mix(total ^ mix(np.array([len(s)], np.uint64))).view(np.int64)[0])


def sketches(docs: DataFrame, words: int, signature: Signature) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id, keys`` of ``docs (doc_id, text_hash, text)``; an empty set has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(x.as_py() for x in batch["text"])
            for at in range(0, batch.num_rows, _SKETCHED):
                part = batch.slice(at, _SKETCHED)
                sets = [shingles(next(found), words) for _ in range(part.num_rows)]
                keys = signature.keys(signature.values(sets))
                empty = np.array([not len(s) for s in sets])
                offsets = np.concatenate(([0], np.cumsum(np.where(empty, 0, keys.shape[1]))))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "text_hash": part["text_hash"],
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_id": pa.array([set_id(s) for s in sets], pa.int64()),
                        "keys": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[~empty].ravel())),
                    }
                )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id long, keys array<long>")


class Forest:
    """Disjoint sets whose root is their smallest member."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def link_sets(sets: list[np.ndarray], groups: list[int], percent: int, queries: int = 0) -> Forest:
    """Join the groups of all pairs of sets that are similar enough.

    The elements of all sets are numbered once; one look-up of all of them then counts what a set
    shares with every other, so a pair costs a few operations per element. With ``queries``, only
    pairs of one of the first ``queries`` sets with one of the rest count. An empty set joins none.
    """
    forest = Forest(groups)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return forest
    starts = np.concatenate(([0], np.cumsum(sizes)))
    distinct, elements = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    marked = np.zeros(len(distinct), bool)
    for i in range(queries or len(sets)):
        first = queries or i + 1
        own = elements[starts[i] : starts[i + 1]]
        marked[own] = True
        hits = owners[starts[first] :][marked[elements[starts[first] :]]]
        marked[own] = False
        shared = np.bincount(hits - first, minlength=len(sets) - first)
        union = sizes[i] + sizes[first:] - shared
        for j in np.flatnonzero((shared > 0) & (100 * shared >= percent * union)):
            forest.join(groups[i], groups[first + j])
    return forest


def _linked(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` that settle which members of a ``task`` are connected by its comparisons.

    ``members``: task, side, id (the set's), component (as known so far), text. Rows are shuffled
    by task and compared group by group while the partition streams by. A row whose text does
    not have the set it stands for (an id that repeats with another text) is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        for _, group in groupby(rows, key=lambda r: r.task):
            held = list(group)
            sets = [shingles(w, words) for w in words_of(r.text for r in held)]
            kept = [i for i, s in enumerate(sets) if set_id(s) == held[i].id]
            held, sets = [held[i] for i in kept], [sets[i] for i in kept]
            groups = [r.component for r in held]
            asked = sum(r.side == _QUERY for r in held)
            if asked in (0, len(held)) and any(r.side != _BOTH for r in held):
                continue
            forest = link_sets(sets, groups, percent, asked)
            moved = [(g, forest.root(g)) for g in set(groups)]
            links = [(g, r) for g, r in moved if g != r]
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    dealt = members.repartition("task").sortWithinPartitions("task", F.desc("side"), "id")
    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    signature: Signature = Signature(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept, text_hash``.

    A document's set holds its distinct shingles of ``words`` words (``textual.shingles``).
    Documents are linked when 100 * intersection >= ``percent`` * union, and ``component_id`` is
    the smallest id reachable over links, the document's own included.

    1. Documents with one and the same set are one class (identity by a 64-bit hash of the set).
    2. Classes sharing a key of the multi-index (``Signature``) form families; only a star to a
       key's smallest class is made, never all pairs of a key.
    3. Within a family all pairs of different components are settled on full sets, in blocks of
       ``BLOCK`` documents: twice with members dealt at random, which joins whatever is densely
       linked, then those outside a family's largest component against all its blocks.

    A null, empty or blank text has an empty set and links with nothing. Rows that repeat an id
    and a text are one document; rows that repeat an id with other texts are judged by their
    texts. A row without an id links with nothing and is kept, its ``component_id`` null. Other
    columns of ``docs`` are not read; an empty table gives an empty result.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    rows = settle(sketches(source, words, signature))
    sound = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = settle(sound.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")))
    keyed = classes.select("set_id", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("set_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = keyed.join(hubs.select("key", "hub"), "key").where("set_id <> hub")
    families = settle(components(stars.select(F.col("set_id").alias("a"), F.col("hub").alias("b")).distinct()))
    reps = classes.select("set_id", "rep")
    linked = _confirmed(source, families.join(reps, families["id"] == reps["set_id"]), words, percent)
    linked = reps.join(linked, reps["set_id"] == linked["id"], "left")
    linked = linked.select("set_id", "rep", F.coalesce("component", "set_id").alias("component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("_least"))
    labels = linked.join(least, "component").select("set_id", "_least")
    found = rows.select("doc_id", "text_hash", "n_shingles", "set_id").join(labels, "set_id", "left")
    mine = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_least")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        mine.alias("component_id"),
        F.col("doc_id").eqNullSafe(mine).alias("kept"),
        "text_hash",
    )


def _confirmed(source: DataFrame, families: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, component`` of the classes in families, by links confirmed on full sets."""
    sizes = families.groupBy("component").agg(F.count("*").alias("size"))
    members = families.join(sizes, "component").select("id", "rep", F.col("component").alias("family"), "size")
    # Only the ids are sorted out by hash; sorting whole texts would spill.
    members = members.hint("shuffle_hash")
    texts = source.join(members, source["doc_id"] == members["rep"]).select("id", "family", "size", "text")
    texts = settle(texts.withColumn("component", F.col("id")))
    blocks = F.ceil(F.col("size") / BLOCK)

    def dealt(df: DataFrame, seed: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id", F.lit(seed)), blocks)
        task = F.xxhash64("family", block).alias("task")
        return df.select(task, F.lit(_BOTH).alias("side"), "id", "component", "text")

    found = _linked(dealt(texts.where(F.col("size") <= BLOCK), 0), words, percent)
    large = texts.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return components(found)
    links = [_linked(dealt(large, seed), words, percent) for seed in (0, 1)]
    links = settle(links[0].unionByName(links[1]))
    known = large.drop("component").join(components(links), "id", "left")
    known = settle(known.withColumn("component", F.coalesce("component", "id")))
    counts = known.groupBy("family", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    outside = F.col("component") != F.col("main")
    parts = known.join(main, "family").where(outside).groupBy("family", "main")
    parts = parts.agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    known = known.join(parts, "family")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    block, part = F.pmod(F.xxhash64("id", F.lit(2)), blocks), F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts"))
    fields = ["family", "id", "component", "text"]
    base = known.select(*fields, F.lit(_BASE).alias("side"), block.alias("b"), every(F.col("parts")).alias("p"))
    asked = known.where(outside).select(*fields, F.lit(_QUERY).alias("side"), every(blocks).alias("b"), part.alias("p"))
    tasks = base.unionByName(asked).withColumn("task", F.xxhash64("family", "b", "p"))
    more = _linked(tasks.select("task", "side", "id", "component", "text"), words, percent)
    return components(found.unionByName(links).unionByName(more))


@register("op5_minhash")
def op5_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
