"""Toxicity by class-conditional Kneser-Ney models of the characters of words."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.registry import register, table
from tideloom.session import settle

#: Characters of the highest order; lower orders back off one character at a time.
ORDER = 4
#: Neutral characters that every text has besides its own, so that a few words decide little.
NEUTRAL = 100
#: Pairs of a document and a word, and characters, from which on a block of documents is closed.
PAIRS, CHARACTERS = 1 << 18, 1 << 24
#: Bins of the length-normalised scores from which the calibration is fitted.
BINS = 4096
#: Steps of a unit of the score in sums.
FINE = float(1 << 40)
#: A score from here on is predicted toxic.
THRESHOLD = 0.7
_OPEN, _CLOSE = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose scores a task remembers at most.
_REMEMBERED = 400_000


def words_in(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def grams_of(word: str) -> list[str]:
    """The character n-grams of a word, opened by marks and closed by one: one per character, one for the end."""
    marked = _OPEN * (ORDER - 1) + word + _CLOSE
    return [marked[i : i + ORDER] for i in range(len(word) + 1)]


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def count_grams(labelled: DataFrame) -> DataFrame:
    """``gram, n0, n1``: occurrences of every n-gram in ordinary and in toxic texts ``(_text, _toxic)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = (Counter(), Counter())

        def counted() -> pd.DataFrame:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for mine, grams in zip(words, found):
                for word, n in mine.items():
                    for gram in grams_of(word):
                        grams[gram] += n
                mine.clear()
            every = list(found[0] | found[1])
            return pd.DataFrame({"gram": every, "n0": [found[0][g] for g in every], "n1": [found[1][g] for g in every]})

        for batch in batches:
            for text, toxic in zip(batch["_text"], batch["_toxic"]):
                words[int(toxic)].update(words_in(text))
            if len(words[0]) + len(words[1]) > _REMEMBERED:
                yield counted()
        if words[0] or words[1]:
            yield counted()

    rows = labelled.mapInPandas(run, "gram string, n0 long, n1 long")
    return rows.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discount(counts: DataFrame, name: str) -> F.Column:
    """Kneser-Ney's absolute discount: n1 / (n1 + 2 n2), from the numbers of counts of one and two."""
    one, two = F.count_if(F.col(name) == 1), F.count_if(F.col(name) == 2)
    found = F.when(one > 0, one / (one + 2 * two)).otherwise(0.5)
    return counts.agg(F.least(F.greatest(found, F.lit(0.1)), F.lit(0.95)).alias("d")).scalar()


def _shared(grams: DataFrame) -> DataFrame:
    """``gram, p``: probabilities of the last characters of the (ORDER - 1)-grams, shared by the classes.

    A Kneser-Ney model of the pooled classes: an n-gram counts as often as there are different
    characters before it, interpolated down to single characters.
    """
    levels, counts = [], grams
    for length in range(ORDER - 1, 0, -1):
        counts = counts.select(F.substring("gram", 2, length).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        counts = settle(counts)
        levels.append(counts)
    lowest = levels.pop()
    below = lowest.select("gram", (F.col("n") / lowest.agg(F.sum("n").alias("all")).scalar()).alias("p"))
    for length in range(2, ORDER):
        counts = levels.pop()
        d = _discount(counts, "n")
        context = F.substring("gram", 1, length - 1).alias("context")
        sums = counts.groupBy(context).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        rows = counts.select("gram", "n", context, F.substring("gram", 2, length - 1).alias("low"))
        rows = rows.join(sums, "context").join(below.select(F.col("gram").alias("low"), "p"), "low")
        kept, spared = F.greatest(F.col("n") - d, F.lit(0.0)), d * F.col("kinds") * F.col("p")
        below = rows.select("gram", ((kept + spared) / F.col("all")).alias("p"))
    return below


def fit(labelled: DataFrame) -> DataFrame:
    """``key, llr``: log-likelihood ratios, toxic to ordinary, of n-grams and of contexts whose n-gram is new.

    Contexts are one character shorter than n-grams, so one table holds both.

    Each class has a Kneser-Ney model of the highest order over its own counts; both back off to
    one shared model, so an expression that neither class has seen often tells them apart little,
    and one whose context neither has seen not at all. Counts cover all rows of ``labelled``; the
    model is written, a row for every n-gram and context, and never held in one place.
    """
    return fit_grams(count_grams(labelled))


def fit_grams(counted: DataFrame) -> DataFrame:
    """``fit`` from ``gram, n0, n1``, the n-grams' occurrences by class."""
    grams = settle(counted)
    sums = [f(c) for c in ("n0", "n1") for f in (F.sum, lambda n: F.count_if(F.col(n) > 0))]
    names = ["all0", "kinds0", "all1", "kinds1"]
    context = F.substring("gram", 1, ORDER - 1).alias("context")
    contexts = settle(grams.groupBy(context).agg(*[s.alias(n) for s, n in zip(sums, names)]))
    d = {c: _discount(grams, f"n{c}") for c in "01"}

    def backoff(c: str) -> F.Column:
        return F.when(F.col(f"all{c}") > 0, d[c] * F.col(f"kinds{c}") / F.col(f"all{c}")).otherwise(1.0)

    def own(c: str) -> F.Column:
        n = F.greatest(F.col(f"n{c}") - d[c], F.lit(0.0))
        return F.when(F.col(f"all{c}") > 0, n / F.col(f"all{c}")).otherwise(0.0)

    shared = _shared(grams).select(F.col("gram").alias("low"), "p")
    rows = grams.select("*", context, F.substring("gram", 2, ORDER - 1).alias("low"))
    rows = rows.join(contexts, "context").join(shared, "low")
    prob = {c: own(c) + backoff(c) * F.col("p") for c in "01"}
    known = rows.select(F.col("gram").alias("key"), F.log(prob["1"] / prob["0"]).alias("llr"))
    new = contexts.select(F.col("context").alias("key"), F.log(backoff("1") / backoff("0")).alias("llr"))
    return settle(known.unionByName(new))


class Grams:
    """The n-grams of many words at once.

    ``keys`` are the distinct n-grams, then the distinct contexts (n-grams without their last
    character). ``index`` numbers the n-grams of all words in order, ``sizes`` of them to a word, and
    ``context`` gives the place in ``keys`` of each distinct n-gram's context.
    """

    def __init__(self, words: Sequence[str]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.sizes = lengths + 1
        text = "".join([_OPEN * (ORDER - 1) + w + _CLOSE for w in words])
        letters, codes = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
        first = np.cumsum(lengths + ORDER) - (lengths + ORDER)
        at = np.repeat(first - (np.cumsum(self.sizes) - self.sizes), self.sizes) + np.arange(self.sizes.sum())
        spelled = np.stack([codes[at + i] for i in range(ORDER)], axis=1)
        grams, self.index = _distinct(spelled)
        contexts, of = _distinct(grams[:, :-1])
        self.context = of + len(grams)
        self.keys = [*_strings(letters[grams]), *_strings(letters[contexts])]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of small numbers, and for each row its place among them."""
    if not len(rows):
        return rows, np.empty(0, np.int64)
    if rows.max() >= 1 << 16:
        found, index = np.unique(rows, axis=0, return_inverse=True)
        return found, index.ravel()
    packed = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        packed = packed << np.uint64(16) | column.astype(np.uint64)
    found, index = np.unique(packed, return_inverse=True)
    shifts = np.arange(rows.shape[1] - 1, -1, -1, dtype=np.uint64) * np.uint64(16)
    return (found[:, None] >> shifts & np.uint64(0xFFFF)).astype(np.int64), index


def _strings(codes: np.ndarray) -> list[str]:
    """Each row of code points as a string."""
    text, width = codes.astype("<u4").tobytes().decode("utf-32-le"), codes.shape[1]
    return [text[i : i + width] for i in range(0, len(text), width)]


def _pressed(values: np.ndarray) -> bytes:
    """Small numbers as bytes: all lowest ones first, then the higher ones, which are mostly zero."""
    return zlib.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpressed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class Block:
    """The words of some documents: the distinct ones, sorted, and how often each document has which.

    Document n has the next ``kinds[n]`` entries of ``at``, rising places in ``words``, and of ``times``.
    """

    FIELDS = ("_words", "_kinds", "_at", "_times")

    def __init__(self, words: list[str], kinds: np.ndarray, at: np.ndarray, times: np.ndarray):
        self.words, self.kinds, self.at, self.times = words, kinds, at, times

    @classmethod
    def of(cls, places: dict[str, int], kinds: array, at: array, times: array) -> Block:
        """From documents' words in any order, each word given by its place."""
        words = sorted(places)
        rank = np.empty(len(words), np.int64)
        rank[[places[w] for w in words]] = np.arange(len(words))
        kinds_, at_, times_ = (np.array(x, np.int64) for x in (kinds, at, times))
        at_ = rank[at_]
        order = np.lexsort((at_, np.repeat(np.arange(len(kinds_)), kinds_)))
        return cls(words, kinds_, at_[order], times_[order])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.kinds)), self.kinds)

    def packed(self) -> list[bytes]:
        steps = np.diff(self.at, prepend=0)
        first = (np.cumsum(self.kinds) - self.kinds)[self.kinds > 0]
        steps[first] = self.at[first]
        return [zlib.compress("\n".join(self.words).encode(), 1), *map(_pressed, (self.kinds, steps, self.times))]

    @staticmethod
    def words_of(data: bytes) -> list[str]:
        text = zlib.decompress(data).decode()
        return text.split("\n") if text else []

    @classmethod
    def unpacked(cls, words: bytes, *rest: bytes) -> Block:
        kinds, steps, times = map(_unpressed, rest)
        total = np.cumsum(steps)
        first = np.cumsum(kinds) - kinds
        before = np.concatenate(([0], total))[first]
        return cls(cls.words_of(words), kinds, total - np.repeat(before, kinds), times)


def _blocks(named: DataFrame) -> DataFrame:
    """Written blocks of ``(_doc_id, _text)``: ``_block``, the documents' ``_ids``, and a packed ``Block``."""
    ids = F.array("_doc_id").alias("_ids")
    fields = [F.lit(None).cast("binary").alias(c) for c in Block.FIELDS]
    schema = named.select(F.lit(0).cast("long").alias("_block"), ids, *fields).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        places: dict[str, int] = {}
        held, kinds, at, times, size = [], array("q"), array("q"), array("q"), 0

        def packed() -> pa.RecordBatch:
            values = pa.concat_arrays(held)
            one = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)]
            one += [pa.array([data], pa.binary()) for data in Block.of(places, kinds, at, times).packed()]
            return pa.RecordBatch.from_arrays(one, names=["_block", "_ids", *Block.FIELDS])

        for batch in batches:
            first = 0
            for row, text in enumerate(batch["_text"]):
                text = text.as_py()
                words = words_in(text)
                kinds.append(len(words))
                at.extend([places.setdefault(word, len(places)) for word in words])
                times.extend(words.values())
                size += len(text or "")
                if len(at) >= PAIRS or size >= CHARACTERS:
                    held.append(batch["_doc_id"].slice(first, row + 1 - first))
                    yield packed()
                    number, first, size = number + 1, row + 1, 0
                    places, held, kinds, at, times = {}, [], array("q"), array("q"), array("q")
            if first < batch.num_rows:
                held.append(batch["_doc_id"].slice(first))
        if held:
            yield packed()

    return settle(named.mapInArrow(run, schema))


def block_grams(blocks: DataFrame, label: DataFrame) -> DataFrame:
    """``count_grams`` of the documents that ``label (_doc_id, _toxic)`` names, once for each of its rows.

    Only ids are joined with labels; blocks are then met by number, so no text is shuffled again.
    """
    ids = blocks.select("_block", F.posexplode("_ids").alias("_place", "_doc_id"))
    named = ids.join(label, "_doc_id").groupBy("_block").agg(F.collect_list(F.struct("_place", "_toxic")).alias("_labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.unpacked(*[batch[c][row].as_py() for c in Block.FIELDS])
                labels = batch["_labels"][row].values
                place, toxic = (np.asarray(labels.field(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in ("_place", "_toxic"))
                grams, owners = Grams(block.words), block.owners()
                counts = []
                for kind in (0, 1):
                    weight = np.bincount(place[toxic == kind], minlength=len(block.kinds))[owners] * block.times
                    of_word = np.bincount(block.at, weight, len(block.words))
                    counts.append(np.bincount(grams.index, np.repeat(of_word, grams.sizes), len(grams.context)).astype(np.int64))
                seen = np.flatnonzero(counts[0] + counts[1])
                found = pa.array([grams.keys[i] for i in seen], pa.string())
                yield pa.RecordBatch.from_arrays([found, *[pa.array(c[seen]) for c in counts]], names=["gram", "n0", "n1"])

    rows = blocks.join(named, "_block").mapInArrow(run, "gram string, n0 long, n1 long")
    return rows.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _keys_of(blocks: DataFrame) -> DataFrame:
    """``_block, _at, key``: the ``Grams.keys`` of every block's words, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch["_block"], batch["_words"]):
                found = pa.array(Grams(Block.words_of(words.as_py())).keys, pa.string())
                numbers = pa.array(np.full(len(found), block.as_py()), pa.int64())
                places = pa.array(np.arange(len(found)), pa.int32())
                yield pa.RecordBatch.from_arrays([numbers, places, found], names=["_block", "_at", "key"])

    return blocks.select("_block", "_words").mapInArrow(run, "_block long, _at int, key string")


def weighed(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """``_doc_id, _x`` of the documents in ``blocks``, as ``evidence`` gives them.

    A block's distinct n-grams and contexts are joined with the model, in which a key meets each
    block once at most, so a frequent one weighs little; a task holds the model's numbers for one
    block. Only their places in the block travel back to it, not the keys.
    """
    found = _keys_of(blocks).join(model, "key").groupBy("_block")
    found = found.agg(F.collect_list(F.struct(F.col("_at").alias("at"), "llr")).alias("_model"))
    joined = blocks.join(found, "_block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.unpacked(*[batch[c][row].as_py() for c in Block.FIELDS])
                grams = Grams(block.words)
                llr = np.full(len(grams.keys), np.nan)
                part = batch["_model"][row].values
                if part is not None:
                    llr[part.field("at").to_numpy()] = part.field("llr").to_numpy()
                llr = np.where(np.isnan(llr[: len(grams.context)]), llr[grams.context], llr[: len(grams.context)])
                word = np.repeat(np.arange(len(block.words)), grams.sizes)
                ratios = np.bincount(word, np.nan_to_num(llr)[grams.index], len(block.words))
                owner = block.owners()
                total = np.bincount(owner, block.times * ratios[block.at], len(block.kinds))
                size = np.bincount(owner, block.times * grams.sizes[block.at], len(block.kinds))
                x = pa.array(total / (size + NEUTRAL), pa.float64())
                yield pa.RecordBatch.from_arrays([batch["_ids"][row].values, x], names=["_doc_id", "_x"])

    out = blocks.select(F.col("_ids")[0].alias("_doc_id"), F.lit(0.0).alias("_x")).schema
    return joined.mapInArrow(run, out)


def evidence(docs: DataFrame, model: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_doc_id, _x``: the log-likelihood ratio of each whole text per character, ``NEUTRAL`` ones added.

    Documents are written in blocks of a bounded number of words (``Block``) and ``weighed``.
    """
    return weighed(_blocks(docs.select(F.col(id_col).alias("_doc_id"), F.col(text_col).alias("_text"))), model)


def calibrate(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots ``x, p`` of a rising curve from scores to probabilities, by pooling adjacent violators.

    A toxic row weighs the square root of the classes' ratio, so that a rare class counts for
    more than its share, and every block is pulled to the whole by one row. Without rows of both
    classes the curve is flat and low.
    """
    if not n0.sum() or not n1.sum():
        return np.zeros(1), np.full(1, 0.1)
    toxic = n1 * np.sqrt(n0.sum() / n1.sum())
    prior = toxic.sum() / (toxic.sum() + n0.sum())
    blocks: list[list[float]] = []
    for place in np.argsort(x, kind="stable"):
        weight = toxic[place] + n0[place]
        blocks.append([x[place] * weight, toxic[place], weight])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [mine + more for mine, more in zip(blocks[-1], last)]
    total, hits, weight = np.array(blocks).T
    return np.maximum.accumulate(total / weight), np.maximum.accumulate((hits + prior) / (weight + 1))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
) -> DataFrame:
    """One row per row of ``docs``: ``_doc_id, _score, _predicted``.

    Labels are used of rows outside the held-out third. Three quarters of them teach the models
    (``fit``), the other rows, which the models have not seen, a rising curve from the
    length-normalised log-likelihood ratio to a probability, from counts in ``BINS`` bins. Texts are read whole, as lower-cased runs of letters. A null or empty text, or one
    without letters, has ratio 0. A label that is null teaches nothing; several labels of one id
    each count; a label without a document is ignored. Without labels of both classes all scores
    are equal and low. Rows of one text score alike. Only the columns named are read.
    """
    label = labels.select(F.col(id_col).alias("_doc_id"), F.col(toxic_col).alias("_toxic")).where("_toxic IN (0, 1)")
    label = settle(label.where(~held_out(F.col("_doc_id"))))
    blocks = _blocks(docs.select(F.col(id_col).alias("_doc_id"), F.col(text_col).alias("_text")))
    apart = F.pmod(F.crc32(F.col("_doc_id").cast("string")), F.lit(12)) < 3
    found = settle(weighed(blocks, fit_grams(block_grams(blocks, label.where(~apart)))))
    seen = found.where(apart).join(label, "_doc_id")
    ends = found.agg(F.min("_x"), F.max("_x")).first()
    low, high = (ends[0] or 0.0), (ends[1] or 0.0)
    width = (high - low) / BINS or 1.0
    bin_of = F.least(F.floor((F.col("_x") - low) / width), F.lit(BINS - 1)).cast("int").alias("bin")
    bins = seen.groupBy(bin_of).agg(
        F.count_if(F.col("_toxic") == 0).alias("n0"),
        F.count_if(F.col("_toxic") == 1).alias("n1"),
        # Whole numbers add up alike in any order.
        (F.sum(F.round(F.col("_x") * FINE).cast("decimal(38,0)")).cast("double") / F.count("*") / FINE).alias("x"),
    )
    bins = bins.orderBy("bin").toArrow()
    knots = calibrate(*(bins[c].to_numpy().astype(float) for c in ("x", "n0", "n1")))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        # A thousandth of a logistic curve keeps the order where the calibrated one is flat.
        return pd.Series(0.999 * np.interp(x, *knots) + 0.001 / (1 + np.exp(-10 * x)))

    scored = found.select("_doc_id", score("_x").alias("_score"))
    return scored.withColumn("_predicted", (F.col("_score") >= THRESHOLD).cast("int"))


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("_doc_id").alias("doc_id"),
        held_out(F.col("_doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        F.col("_predicted").alias("predicted"),
    )
