"""The training-text pipeline: language, near duplicates, contamination, mixture, shards.

Every stage takes and returns the columns of ``documents``, whatever they are, and keeps all rows
that its decision does not concern; the last adds the shard of each row. Null and empty texts go in
the first stage; given to a later one they have no near duplicate, hold no benchmark item, have size
0 in the mixture and size 1 in a shard. An empty table stays empty, rows that repeat an id are judged
by their texts, and further columns are handed through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm.decontaminate import contamination
from tideloom.llm.langid import UNKNOWN, fit, identify
from tideloom.llm.minhash import near_duplicates
from tideloom.llm.mixing import mix_sources
from tideloom.llm.registry import table
from tideloom.llm.sharding import shard_documents
from tideloom.session import configure, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(name: str, taken: list[str]) -> str:
    """``name``, or the first of ``name_2, name_3, ...`` that is not taken."""
    n, found = 1, name
    while found.lower() in {t.lower() for t in taken}:
        n += 1
        found = f"{name}_{n}"
    return found


#: Languages whose texts go on (None: all that the labels teach), and the least share of the
#: probability that the predicted one must have.
WANTED: tuple[str, ...] | None = None
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts of a wanted language that the model tells apart: its score is ``LEAST_SCORE`` or more.

    Null, empty and letterless texts are ``und`` with score 0 and go, as do texts that fit several
    languages alike. Without labels there are no languages and nothing is kept. Repeated rows agree.
    """
    configure(spark)
    found = identify(docs, fit(docs), keep=docs.columns)
    told = (F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= LEAST_SCORE)
    if WANTED is not None:
        told = told & F.col("_lang_pred").isin(*WANTED)
    return found.where(told).select("_kept.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of near duplicates (five words, 0.8)."""
    configure(spark)
    found = near_duplicates(docs, words=5, percent=80)
    gone = settle(found.where(~F.col("kept")).select("doc_id", "text_hash").distinct())
    mine = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone.hint("shuffle_hash"), mine, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a benchmark item."""
    configure(spark)
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.where(~F.col("_contaminated")).select("_kept.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each text as often as the mixture wants it: not at all, once, or up to three times."""
    configure(spark)
    mixed = mix_sources(docs, keep=docs.columns).where("_copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    return mixed.select("_kept", copies).select("_kept.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row into a shard and number the rows of each."""
    configure(spark)
    placed = shard_documents(docs, keep=docs.columns)
    return placed.select(
        "_kept.*",
        F.col("_shard").alias(_free("shard", docs.columns)),
        F.col("_slot").alias(_free("slot", docs.columns)),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Models, near-duplicate links and tiles are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = settle(docs)
    return docs
