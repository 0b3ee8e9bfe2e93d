"""Exact duplicates: frequent digests are settled map-side, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.llm.registry import register, table
from tideloom.session import settle

#: Counters of the frequent-item summary, and how many of the digests it reports are set apart.
#: The broadcast never exceeds 256 rows; a digest beyond them is shuffled like the rest, and holds less than 1 row in 256.
COUNTERS = 1024
HEAVY = 256


def normalised(text: Column) -> Column:
    """White space runs become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``normalised``; of equal ones the smallest id stays.

    A Misra-Gries summary of all digests (Spark's ``approx_top_k``) names the candidates for
    frequent digests. Their exact counts and smallest ids are then aggregated, and these
    verified winners, at most ``HEAVY`` rows, are broadcast: rows of a frequent digest are
    settled where they are and never shuffled, so a text that fills a third of the table is no
    hot key. The remaining digests are shuffled, each group being a small share of the rows.

    Null text counts as empty, and empty texts form a group like any other. Rows that repeat an
    id within a group are one document: each of them counts in ``group_size`` and carries the
    same mark. A row without an id stays only in a group where no row has one. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    digests = settle(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    )
    found = digests.select(F.expr(f"approx_top_k(text_sha256, {HEAVY}, {COUNTERS})").alias("top"))
    candidates = found.select(F.explode("top.item").alias("text_sha256"))
    group = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    winners = settle(
        digests.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*group)
    )
    marked = digests.join(F.broadcast(winners), "text_sha256", "left")
    heavy = marked.where(F.col("group_size").isNotNull())
    same = Window.partitionBy("text_sha256")
    light = marked.where(F.col("group_size").isNull()).select(
        "text_sha256",
        "doc_id",
        F.min("doc_id").over(same).alias("keep_id"),
        F.count("*").over(same).alias("group_size"),
    )
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


@register(
    "op4_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    ), g AS (
        SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
    )
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM d JOIN g USING (text_sha256)
    """,
)
def op4_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))
