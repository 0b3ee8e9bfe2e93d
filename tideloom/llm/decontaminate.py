"""Benchmark decontamination by greedy string tiling over running Karp-Rabin hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.registry import packed, register, table
from tideloom.llm.textual import rolling, words_of
from tideloom.session import settle

#: Words that documents and benchmark items must share in a row, and the shortest tile.
SEED_WORDS = 5
#: Share of an item's words, in percent, that tiles must cover.
COVERAGE = 80
#: Bytes of benchmark texts up to which every task may hold them all; a larger benchmark is joined.
HELD_BYTES = 64_000_000
#: Benchmark items that are sent to the tasks at once, and the most words of one such block.
BLOCK_ITEMS, BLOCK_WORDS = 50_000, 4_000_000
#: Bits of the filter that tells which seeds of documents a larger benchmark may hold: 16 MB whatever its size.
FILTER_BITS = 1 << 27


@dataclass
class Items:
    """A block of benchmark items, indexed by the hashes of their seeds."""

    ids: list[int]
    words: list[np.ndarray]
    seed_words: int

    def __post_init__(self):
        seeds = [rolling(w, min(self.seed_words, max(1, len(w)))) for w in self.words]
        hashes = np.concatenate([*seeds, np.empty(0, np.uint64)])
        owners = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.owners = hashes[order], owners[order]
        self.lengths = sorted({min(self.seed_words, max(1, len(w))) for w in self.words})

    def sharing(self, doc: np.ndarray) -> list[int]:
        """Items that share a seed with a document."""
        found = [np.empty(0, np.int64)]
        for k in self.lengths:
            own = np.unique(rolling(doc, k))
            left = np.searchsorted(self.seeds, own, "left")
            right = np.searchsorted(self.seeds, own, "right")
            found += [self.owners[a:b] for a, b in zip(left[left < right], right[left < right])]
        return np.unique(np.concatenate(found)).tolist()


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> int:
    """How many words of ``item`` greedy string tiling covers with runs of words of ``doc``.

    The longest run that both share and that no tile has marked is a tile, and is marked in
    both; and so on, down to ``least`` words, ties going to the earliest place in the item and
    then in the document. The longest length left is found by bisection, as a shared run holds
    shorter ones; running hashes tell whether one of a given length is left, at one subtraction and
    product for a place, and equal hashes are confirmed word by word.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return 0
    # Only the surroundings of a seed can be in a tile.
    near = np.flatnonzero(np.isin(rolling(doc, least), rolling(item, least)))
    if not len(near):
        return 0
    reach = np.zeros(len(doc) + 1, np.int64)
    np.add.at(reach, near, 1)
    np.add.at(reach, near + least, -1)
    free_item, free_doc = np.ones(len(item), bool), np.cumsum(reach[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free_doc.view(np.int8), [0]))))
    bound = min(len(item), int((edges[1::2] - edges[::2]).max()))
    mine, theirs, covered = Running(item), Running(doc), 0

    def shared(length: int) -> tuple[int, int] | None:
        return _run(mine, theirs, _free(free_item, length), _free(free_doc, length), length)

    while bound >= least and len(item) - covered >= least:
        low, high = least - 1, bound
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (low, middle - 1) if shared(middle) is None else (middle, high)
        if low < least:
            break
        while (found := shared(low)) is not None:
            i, j = found
            free_item[i : i + low] = False
            free_doc[j : j + low] = False
            covered += low
        bound = low - 1
    return covered


class Running:
    """Karp-Rabin hashes of all runs of words, from sums up to every place."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: np.ndarray):
        self.words = words
        back = pow(self.BASE, -1, 1 << 64)
        powers, self.back = (np.full(len(words) + 1, b, np.uint64) for b in (self.BASE, back))
        powers[0] = self.back[0] = 1
        powers, self.back = np.multiply.accumulate(powers), np.multiply.accumulate(self.back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)))

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.back[starts]


def _run(item: Running, doc: Running, mine: np.ndarray, theirs: np.ndarray, length: int) -> tuple[int, int] | None:
    """The first run of ``length`` words that begins at one of ``mine`` and, in the document, of ``theirs``."""
    if not len(mine) or not len(theirs):
        return None
    own, hashes = item.at(mine, length), doc.at(theirs, length)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    place = np.searchsorted(ranked, own)
    equal = ranked[np.minimum(place, len(ranked) - 1)] == own
    for i, h, p in zip(mine[equal], own[equal], place[equal]):
        while p < len(order) and ranked[p] == h:
            j = theirs[order[p]]
            if np.array_equal(item.words[i : i + length], doc.words[j : j + length]):
                return int(i), int(j)
            p += 1
    return None


def _free(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs of ``length`` unmarked words."""
    if len(free) < length:
        return np.empty(0, np.int64)
    sums = np.concatenate(([0], np.cumsum(~free)))
    return np.flatnonzero(sums[length:] == sums[: len(sums) - length])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = SEED_WORDS,
    coverage: int = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``_kept`` (a struct of the ``keep`` columns), ``_doc_id, _contaminated,
    _coverage, _items``.

    ``_items`` lists, in order, the benchmark items of which tiles of at least ``seed_words`` words
    cover at least ``coverage`` percent of the words, in whatever order the passages stand in the
    document; an item of fewer words is one tile. ``_coverage`` is the largest share (0 to 100,
    rounded down) among the items that share a seed with the document.

    The size of the benchmark is looked up first. One of up to ``HELD_BYTES`` goes to every task in
    blocks, its seeds being the build side of a map-side join: documents are read whole and stay where
    they are (``_held``). A larger one is joined: seeds of documents that a filter of fixed size lets
    through meet the items' seeds by an ordinary join, and each pair of a text and an item that
    share one is tiled where the join brings them together (``_joined``). Both give the same
    rows, and every decision concerns one text.

    Words are lower-cased (A-Z) runs other than white space. Null, empty or blank documents and
    items match nothing, and such a document is clean with coverage 0. Repeated items are listed
    as often as their ids differ; an item without an id is ignored.
    """
    inside = text_col if text_col in keep else None
    read = [] if inside else [F.col(text_col).alias("_text")]
    named = docs.select(*packed(keep), F.col(id_col).alias("_doc_id"), *read)
    out = [c for c in named.columns if c != "_text"]
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text_col).alias("_words"))
    items = items.where("_item IS NOT NULL AND _words IS NOT NULL")
    bytes_ = items.agg(F.sum(F.octet_length("_words"))).first()[0] or 0
    text = f"_kept.`{inside}`" if inside else "_text"
    found = _held(named, inside, items, seed_words, coverage) if bytes_ <= HELD_BYTES else _joined(named, text, items, seed_words, coverage)
    flag = F.size("_items") > 0
    listed = F.array_sort(F.array_distinct("_items"))
    return found.select(*out, flag.alias("_contaminated"), "_coverage", listed.alias("_items"))


def _held(docs: DataFrame, inside: str | None, items: DataFrame, seed_words: int, coverage: int) -> DataFrame:
    found = docs.withColumns({"_coverage": F.lit(0).cast("int"), "_items": F.array().cast("array<long>")})
    for block in _blocks(items):
        found = _tiled(found, inside, block, seed_words, coverage)
    return found


def _seeds(words: np.ndarray, seed_words: int) -> np.ndarray:
    """Hashes of the seeds of an item: of all its words if it has fewer."""
    return np.unique(rolling(words, min(seed_words, max(1, len(words)))))


def _joined(docs: DataFrame, text: str, items: DataFrame, seed_words: int, coverage: int) -> DataFrame:
    """``docs`` with ``_coverage`` and ``_items``, by joins of seeds and then of texts with items.

    Texts are known by two hashes and their length, and each distinct one is worked on once.
    """
    key = [F.xxhash64(text).alias("_a"), F.crc32(F.col(text).cast("binary")).alias("_b"), F.octet_length(text).alias("_c")]
    by = ["_a", "_b", "_c"]

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in zip(batch["_item"].to_pylist(), words_of(x.as_py() for x in batch["_words"])):
                own = _seeds(words, seed_words).view(np.int64)
                if len(words):
                    size = pa.array(np.full(len(own), min(seed_words, len(words))), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), size, pa.array(np.full(len(own), row), pa.int64())], names=["_seed", "_size", "_item"]
                    )

    seeds = settle(items.mapInArrow(seeded, "_seed long, _size int, _item long"))
    # Bitmaps number positive values without gaps.
    at = F.pmod("_seed", F.lit(FILTER_BITS)) + 1
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    filled = seeds.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(bitmap).collect()
    lengths = sorted(r["_size"] for r in seeds.select("_size").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["bits"]) for r in filled})

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Buckets are numbered from 1, the bits of one from 0.
        width = 8 * 4096
        bits = np.zeros((FILTER_BITS // width + 2, 4096), np.uint8)
        for bucket, data in shared.value.items():
            bits[bucket, : len(data)] = np.frombuffer(data, np.uint8)
        for batch in batches:
            for n, words in enumerate(words_of(x.as_py() for x in batch["_text"])):
                own = np.unique(np.concatenate([rolling(words, k) for k in lengths] or [np.empty(0, np.uint64)])).view(np.int64)
                place = own % FILTER_BITS
                inside = place % width
                own = own[bits[place // width + 1, inside // 8] >> (inside % 8).astype(np.uint8) & 1 == 1]
                if len(own):
                    same = [pa.array([batch[c][n].as_py()] * len(own), batch[c].type) for c in by]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(own)], names=[*by, "_seed"])

    texts = docs.select(*key, F.col(text).alias("_text")).where("_text IS NOT NULL")
    offered = texts.mapInArrow(possible, "_a long, _b long, _c int, _seed long").distinct()
    pairs = settle(offered.join(seeds, "_seed").select(*by, "_item").distinct())
    # One copy of each text that shares a seed with an item.
    asked = texts.join(pairs.select(*by).distinct(), by, "left_semi").dropDuplicates(by)
    met = pairs.join(asked, by).join(items.dropDuplicates(), "_item")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, own = (words_of(x.as_py() for x in batch[c]) for c in ("_text", "_words"))
            # An id may come with several texts; those that share no seed with the document stay out.
            share = []
            for doc, item in zip(docs_, own):
                met = len(item) and np.isin(_seeds(item, seed_words), rolling(doc, min(seed_words, max(1, len(item))))).any()
                share.append(100 * tile(item, doc, seed_words) // len(item) if met else 0)
            columns = {c: batch[c] for c in (*by, "_item")}
            yield pa.RecordBatch.from_pydict(columns | {"_share": pa.array(share, pa.int32())})

    scored = met.repartition("_item", *by).mapInArrow(tiles, "_a long, _b long, _c int, _item long, _share int")
    hit = F.collect_set(F.when(F.col("_share") >= coverage, F.col("_item")))
    best = settle(scored.groupBy(*by).agg(F.max("_share").alias("_coverage"), hit.alias("_items")))
    keyed = docs.select("*", *key).join(best, by, "left").drop(*by)
    return keyed.withColumns(
        {"_coverage": F.coalesce("_coverage", F.lit(0)), "_items": F.coalesce("_items", F.array().cast("array<long>"))}
    )


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items of a benchmark of bounded size, in blocks."""
    held, words = [], 0
    for item, text in items.collect():
        held.append((item, text))
        words += len(text) // 4
        if len(held) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def _tiled(docs: DataFrame, inside: str | None, block: list[tuple[int, str]], seed_words: int, coverage: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = zip(*shared.value)
        own = [(i, w) for i, w in zip(ids, words_of(texts)) if i is not None and len(w)]
        items = Items([i for i, _ in own], [w for _, w in own], seed_words)
        for batch in batches:
            texts = batch["_kept"].field(inside) if inside else batch["_text"]
            best, lists = batch["_coverage"].to_pylist(), batch["_items"].to_pylist()
            for n, words in enumerate(words_of(x.as_py() for x in texts)):
                for at in items.sharing(words):
                    item = items.words[at]
                    share = 100 * tile(item, words, seed_words) // len(item)
                    best[n] = max(best[n], share)
                    if share >= coverage:
                        lists[n].append(items.ids[at])
            columns = dict(zip(batch.schema.names, batch.columns))
            columns |= {"_coverage": pa.array(best, pa.int32()), "_items": pa.array(lists, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)


@register("op8_decontaminate")
def op8_decontaminate(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_contaminated").alias("contaminated"),
        F.col("_coverage").alias("coverage"),
        F.col("_items").alias("items"),
    )
