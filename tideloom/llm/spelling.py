"""Spelling variants of the words of a corpus, found by asymmetric q-chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.llm.registry import register, table
from tideloom.session import settle

#: Words on one side of a chunk that are verified against the other side; beyond it the words
#: of the chunk are joined by what is left of them without one letter (``_crowded``).
COMPARED = 256
#: Distinct words a task gathers before it hands their counts on.
_HELD = 200_000


def planted_error(run: str, prefix: int, every: int) -> str:
    """``run`` without one code point if its hash, begun at ``prefix``, divides by ``every``."""
    h = crc32(run.encode(), prefix)
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, shortest: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """``word, n``: the runs of letters of all texts with at least ``shortest`` code points.

    Each task counts whole batches before it hands rows on, so a word that fills a third of the
    corpus is a few rows per task; Spark adds the counts.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for id_, data in zip(batch["doc_id"].to_pylist(), batch["data"]):
                # Lower-casing bytes touches A-Z only.
                text = (data.as_py() or b"").lower().decode("utf-8", "replace")
                prefix = crc32(f"{'null' if id_ is None else id_}:".encode())
                for word, n in Counter(runs.findall(text)).items():
                    word = planted_error(word, prefix, every)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) > _HELD:
                    yield flush()
        yield flush()

    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _key(size: Column, which: int, gram: Column) -> Column:
    return F.struct(size.alias("size"), F.lit(which).alias("which"), gram.alias("gram"))


def _keys(word: Column, shortest: int) -> tuple[Column, Column]:
    """The keys of a word as the chunked one, and as the one that gives grams.

    A word of ``size`` code points has two disjoint chunks of ``size // 2``, at 0 and at
    ``size // 2``. A word of the same length, or one longer, that is one edit away holds one of
    them unharmed, in its place or, if it is longer, one further on. So it gives its positional
    grams of that length in those places, for both lengths its partner may have; grams that lie
    further than that from a chunk's place could join nothing.
    """
    size = F.length(word)

    def grams(partner: Column, shifts: int) -> list[Column]:
        q = F.floor(partner / 2).cast("int")
        return [_key(partner, i, F.substring(word, q * i + s + 1, q)) for i in range(2) for s in range(shifts)]

    shorter = F.when(size > shortest, F.array(*grams(size - 1, 2))).otherwise(F.array().cast("array<struct<size:int,which:int,gram:string>>"))
    return F.array(*grams(size, 1)), F.array_distinct(F.concat(F.array(*grams(size, 1)), shorter))


def _crowded(words: DataFrame) -> DataFrame:
    """All links among ``words``, by what is left of a word without one code point.

    Two words of one length are one replacement apart if they agree without the code point in
    some place; as many words agree there as the alphabet has letters, all of them near each
    other. A longer word is one insertion away from a word that is left of it.
    """
    place = F.explode(F.sequence(F.lit(1), F.length("word")))
    rest = F.concat(F.expr("substring(word, 1, place - 1)"), F.expr("substring(word, place + 1)"))
    variants = words.select("word", place.alias("place")).withColumn("rest", rest)
    alike = variants.groupBy("rest", "place").agg(F.array_sort(F.collect_list("word")).alias("ws")).where(F.size("ws") > 1)
    later = F.transform("ws", lambda x, i: F.transform(F.slice("ws", i + 2, F.size("ws")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    replaced = alike.select(F.explode(F.flatten(later)).alias("l")).select("l.*")
    inserted = variants.select(F.col("word").alias("b"), F.col("rest").alias("a")).distinct()
    return replaced.unionByName(inserted.join(words.select(F.col("word").alias("a")), "a").select("a", "b"))


def one_edit_links(words: DataFrame, shortest: int) -> DataFrame:
    """``a, b``, once per pair: distinct words of ``words (word)`` that are one edit apart.

    The shorter word of a pair (the smaller of two of one length) contributes its two chunks, the
    other its positional grams (``_keys``); they are joined on length, chunk and gram, and every
    meeting is verified. Where a key has more than ``COMPARED`` words on a side, all its words are
    linked by ``_crowded`` instead, so no group is ever multiplied out and none is cut.
    """
    chunks, grams = _keys(F.col("word"), shortest)
    left = words.select(F.col("word").alias("a"), F.explode(chunks).alias("k")).select("a", "k.*")
    right = words.select(F.col("word").alias("b"), F.explode(grams).alias("k")).select("b", "k.*")
    key = ["size", "which", "gram"]
    sides = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    # Every word has its own chunk among its grams, so only keys with two grams can link words.
    sizes = settle(sides.groupBy(*key).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l > 0 AND r > 1"))
    few = sizes.where(F.greatest("l", "r") <= COMPARED).select(*key)
    many = sizes.where(F.greatest("l", "r") > COMPARED).select(*key)
    met = left.join(few, key).join(
        right.withColumnsRenamed({k: f"_{k}" for k in key}),
        (F.col("size") == F.col("_size"))
        & (F.col("which") == F.col("_which"))
        & (F.col("gram") == F.col("_gram"))
        & ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
        & (F.levenshtein("a", "b", 1) == 1),
    )
    crowd = right.join(many, key, "left_semi").select(F.col("b").alias("word")).distinct()
    return met.select("a", "b").unionByName(_crowded(crowd)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` (form not null): each round doubles the steps taken.

    Every step at least multiplies the count, so paths are short and have no cycles.
    """
    paths = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = settle(paths.join(ahead, "root", "left"))
        if longer.where("_next IS NOT NULL").isEmpty():
            return paths
        paths = longer.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_variants(
    docs: DataFrame,
    shortest: int = 7,
    least: int = 2,
    ratio: int = 10,
    every: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, that have
    ``shortest`` code points and occur ``least`` times in all texts. ``n_near`` counts the words
    one edit away; the one of largest ``n`` (of equals the first in code-point order) is the
    ``form`` if it occurs ``ratio`` times as often, and ``root`` is the end of that path.
    ``every`` plants errors: in one of so many runs, by a hash of id and run, a letter is deleted.

    A null, empty or wordless text adds no words; a null id is hashed as ``null``; repeated rows
    count each time; other columns are not read; an empty table gives an empty result. A word
    that crowds with more than ``COMPARED`` others costs the square of its own length.
    """
    words = settle(word_counts(docs, shortest, every, id_col, text_col).where(F.col("n") >= least))
    links = settle(one_edit_links(words.select("word"), shortest))
    both = links.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        links.select(F.col("b").alias("word"), F.col("a").alias("near"))
    )
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The smallest of (-n, word) is the most frequent near word, and the first of equals.
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(found, "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    rows = settle(
        rows.select(
            "word",
            F.when(strong, F.col("best.w")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = _roots(rows.where("form IS NOT NULL"))
    rows = rows.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@register("op12_spelling")
def op12_spelling(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"), shortest=7, least=2, ratio=10, every=31)
