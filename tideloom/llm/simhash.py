"""Near duplicates by SimHash fingerprints that are joined on deletion variants of their segments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.llm.components import components
from tideloom.llm.registry import register, table
from tideloom.operators.ordering import spread
from tideloom.session import settle

BITS = 64
#: Seed of the shingle hash.
SEED = 42
#: Shingles hashed at once, so that a very long text takes no more memory than its words do.
_BLOCK = 1 << 16
#: Fingerprints that are compared with each other under one key; more of them are joined by
#: variants of the whole fingerprint instead (``_crowded``).
COMPARED = 64


def fingerprint(data: bytes, words: int = 3) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number.

    A-Z are lower-cased; ``bytes.split`` cuts at the six ASCII white space characters. A bit is 1
    if it is set in more than half the hashes of the shingles, repeats included.
    """
    tokens = data.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    n = max(len(tokens) - words + 1, 1)
    first, last = (ends - lengths)[:n], ends[-n:]
    digest = partial(xxhash.xxh64_digest, seed=SEED)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        spans = map(slice, first[at : at + _BLOCK].tolist(), last[at : at + _BLOCK].tolist())
        digests = b"".join(map(digest, map(joined.__getitem__, spans)))
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, fp`` of every row; a null text has the fingerprint of an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"", words) for x in batch["data"]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fp": pa.array(found, pa.int64())})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def segment_variants(distance: int) -> list[tuple[int, int]]:
    """``(kept, wildcard)`` bit masks of all variants of all segments.

    The bits are cut into ``distance // 2 + 1`` segments: if each differed by two bits or more,
    more than ``distance`` bits would differ, so one segment differs by one bit at most. Its
    variants leave out one bit each; the plain segment is the variant without a wildcard.
    """
    count = distance // 2 + 1
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        segment = (1 << high) - (1 << low)
        out += [(segment, 0), *[(segment & ~(1 << b), 1 << b) for b in range(low, high)]]
    return out


def _pairs(members: Column, wildcard: Column, distance: int) -> Column:
    """The members within ``distance`` that differ in the wildcard bit, as an array of links.

    Members alike in a whole segment meet in its plain variant, so the other variants leave them out.
    """

    def near(x: Column, y: Column) -> Column:
        apart = x.bitwiseXOR(y)
        return (F.bit_count(apart) <= distance) & ((wildcard == 0) | (apart.bitwiseAND(wildcard) != 0))

    def of(x: Column, i: Column) -> Column:
        later = F.filter(F.slice(members, i + 2, COMPARED), lambda y: near(x, y))
        return F.transform(later, lambda y: F.struct(x.alias("a"), y.alias("b")))

    return F.flatten(F.transform(members, of))


def _crowded(fps: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints that share too common a variant, by variants of the whole.

    Fingerprints within ``distance`` bits agree once some ``distance`` bits are left out, and no
    more than ``2 ** distance`` fingerprints agree on one such variant. So groups are small by
    construction however many fingerprints there are, and a star links what each holds.
    """
    masks = _longs([sum(1 << b for b in bits) for bits in combinations(range(BITS), distance)])
    left_out = F.transform(masks, lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(F.bitwise_not(m)).alias("part")))
    # A fingerprint is a few bytes but many variants: it is dealt out before it is multiplied.
    variants = spread(fps, ["fp"]).select("fp", F.explode(left_out).alias("v")).select("fp", "v.*")
    groups = variants.groupBy("mask", "part").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 2**distance)).alias("b"))


def hamming_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` within ``distance`` (1 or 2) bits.

    Every fingerprint is indexed by the variants of its segments (``segment_variants``), an
    equality join meets those that share one, and each meeting is verified on the whole
    fingerprints. Up to ``COMPARED`` fingerprints of a variant are compared with each other, so a
    row costs a bounded number of comparisons; the members of larger groups are joined once more
    by ``_crowded``, which finds all links among them. Hot variants thus never make pairs.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    masks = segment_variants(distance)
    kept, wildcards = _longs([m for m, _ in masks]), _longs([w for _, w in masks])
    parts = F.transform(kept, lambda m, i: F.struct(i.alias("tag"), F.col("fp").bitwiseAND(m).alias("part")))
    keyed = spread(fps, ["fp"]).select("fp", F.explode(parts).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("tag", "part").agg(F.count("*").alias("n")).where("n > 1")
    # Written, as both paths below read it; few variants are shared. Spark sizes the variants by the
    # fingerprints they come from and would broadcast them all; the hint keeps them shuffled.
    shared = settle(keyed.hint("merge").join(sizes, ["tag", "part"]))
    small = shared.where(F.col("n") <= COMPARED).repartition("tag", "part").groupBy("tag", "part")
    small = small.agg(F.collect_list("fp").alias("fps")).withColumn("wildcard", wildcards[F.col("tag")])
    links = small.select(F.explode(_pairs(F.col("fps"), F.col("wildcard"), distance)).alias("l")).select("l.*")
    crowd = shared.where(F.col("n") > COMPARED).select("fp").distinct()
    return links.unionByName(_crowded(crowd, distance))


def simhash_groups(
    docs: DataFrame, words: int = 5, distance: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links between fingerprints that differ in
    at most ``distance`` bits, the row's own included. Documents with one fingerprint are one
    class, so copies cost one row in the index; a class is named by its smallest id.

    A text of fewer than ``words`` words is one shingle. A null, empty or blank text has
    fingerprint zero and is linked like any other. Rows that repeat an id are judged by their
    texts. A row without an id belongs to its component but does not name it; a component of such
    rows alone has a null ``component_id``. Other columns are not read; an empty table gives an
    empty result.
    """
    rows = settle(fingerprints(docs, words, id_col, text_col))
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(hamming_links(classes.select("fp"), distance))
    named = classes.join(found, classes["fp"] == found["id"], "left")
    named = named.select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "component").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), BITS // 4, "0").alias("fingerprint")
    return rows.join(labels, "fp").select("doc_id", digits, "component_id")


@register("op11_simhash")
def op11_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, distance=2)
