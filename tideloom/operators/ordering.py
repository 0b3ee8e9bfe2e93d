"""Order without a single-task sort.

Rows of one series are numbered by grid arithmetic (``grid_position``) or, for irregular
rows, by a cluster-wide range sort (``row_position``). Everything that looks at neighbours
then works on *chunks* of a fixed number of positions, with a halo of copied rows where a
frame crosses the chunk edge. No operator sorts, windows or collects a whole series, so one
series may hold any share of the data.

Series keys must not be NULL; ``typed_ingest`` routes such rows to its error column.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideloom.functions.times import steps_between
from tideloom.session import settle

CHUNK = 8192
BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)
FROM_HERE = (0, Window.unboundedFollowing)


def attach(df: DataFrame, params: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add per-series parameters to the rows.

    With keys this is a join whose strategy is left to Spark, which knows the sizes; without
    keys ``params`` is a single row and becomes a scalar subquery. The keys are joined as one struct: what is
    grouped or ordered by series afterwards is then dealt anew, after partial sums, and a hot
    series stays split where Spark splits it for the join.
    """
    if keys:
        rest = [c for c in params.columns if c not in keys]
        keyed = params.select(F.struct(*keys).alias("_keys"), *rest)
        return df.join(keyed, F.struct(*[F.col(k) for k in keys]) == F.col("_keys"), how).drop("_keys")
    one = params.select(F.struct("*").alias("_params")).scalar()
    names = params.columns
    return df.withColumn("_params", one).select("*", *[F.col(f"_params.{n}") for n in names]).drop("_params")


def attach_left(df: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``attach`` that keeps rows without parameters."""
    return attach(df, params, keys, "left")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition rows that cost more than their bytes over all shuffle partitions.

    Rows that are solved or cut into windows are small and much work; partitions sized by
    bytes would merge them into a handful of tasks. A later grouping by ``keys`` reuses this
    partitioning.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys)


def grid_position(
    df: DataFrame, period: timedelta, keys: Sequence[str], ts: str = "ts", pos: str = "pos"
) -> DataFrame:
    """0-based position on a regular grid: arithmetic only, after one ``min`` per series."""
    start = df.groupBy(*keys).agg(F.min(ts).alias("_start"))
    return attach(df, start, keys).withColumn(
        pos, steps_between(F.col("_start"), F.col(ts), period)
    ).drop("_start")


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sort the table by ``keys, order`` over the cluster and freeze the layout.

    ``order`` must be unique inside a series, so that a hot series spreads over as many
    slices as its size needs. ``_slice`` numbers the sorted partitions and ``_idx`` rises
    with the order. Both are written before they are used: a recomputed task cannot
    renumber them.
    """
    sort = [*keys, *order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return settle(
        placed.withColumn("_slice", F.spark_partition_id()).withColumn(
            "_idx", F.monotonically_increasing_id()
        )
    )


def _run_offsets(runs: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Sum of ``size`` over the earlier slices of the same series (one row per slice)."""
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*BEFORE)
    return runs.withColumn("_offset", F.sum(size).over(earlier)).drop(size)


def row_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str = "pos"
) -> DataFrame:
    """0-based position inside each series for rows on no grid."""
    rows = ordered_slices(df, keys, order)
    runs = rows.groupBy(*keys, "_slice").agg(F.min("_idx").alias("_low"), F.count("*").alias("_n"))
    placed = rows.join(_run_offsets(runs, keys, "_n"), [*keys, "_slice"])
    position = F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_idx") - F.col("_low")
    return placed.select(*df.columns, position.alias(pos))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: str,
    name: str = "total",
    whole: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` in ``order``, as column ``name``.

    ``whole`` names a further column for the sum over the series.
    """
    rows = ordered_slices(df, keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy("_idx").rowsBetween(*SO_FAR)
    runs = rows.groupBy(*keys, "_slice").agg(F.sum(weight).alias("_sum"))
    extra = []
    if whole is not None:
        runs = runs.withColumn(whole, F.sum("_sum").over(Window.partitionBy(*keys)))
        extra = [whole]
    placed = rows.withColumn("_inside", F.sum(weight).over(inside)).join(
        _run_offsets(runs, keys, "_sum"), [*keys, "_slice"]
    )
    total = F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_inside")
    return placed.select(*df.columns, total.alias(name), *extra)


def earlier_sum(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    size: str,
    name: str,
    chunk: int = CHUNK,
    levels: int = 1,
) -> DataFrame:
    """Sum of ``size`` over the rows of a series with a smaller ``at``.

    For tables with a row per chunk: blocks of ``chunk`` rows are summed first and only the
    block sums are run through per series, once more for every level.
    """
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(*BEFORE)), F.lit(0))
    if levels == 0:
        return df.withColumn(name, before)
    rows = df.withColumn("_block", chunk_of(at, chunk)).repartition(*keys, "_block")
    sums = rows.groupBy(*keys, "_block").agg(F.sum(size).alias("_sum"))
    sums = earlier_sum(sums.withColumnRenamed("_block", "_at"), keys, "_at", "_sum", "_earlier", chunk, levels - 1)
    sums = sums.select(*keys, F.col("_at").alias("_block"), F.col("_earlier").alias("_above"))
    block = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(*BEFORE)
    inside = F.coalesce(F.sum(size).over(block), F.lit(0))
    rows = rows.withColumn("_inside", inside).join(sums, [*keys, "_block"])
    return rows.withColumn(name, F.col("_above") + F.col("_inside")).drop("_block", "_above", "_inside")


def chunk_of(pos: str, chunk: int) -> Column:
    return F.floor(F.col(pos) / F.lit(chunk)).cast("bigint")


def with_halo(
    df: DataFrame, chunk: int, before: int = 0, after: int = 0, pos: str = "pos", keys: Sequence[str] = ()
) -> DataFrame:
    """Assign rows to chunks of ``chunk`` positions, copying the rows that neighbours need.

    Chunk ``j`` owns positions ``[j*chunk, (j+1)*chunk)`` (``_home`` is true there) and also
    sees ``before`` rows ahead of them and ``after`` rows behind them. Rows are shuffled by series
    and chunk: where they lie by series already, as after a join, a window over chunks would
    otherwise stay there and leave a hot series to one task.
    """
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - after) / F.lit(chunk))).cast("bigint")
    last = F.floor((F.col(pos) + before) / F.lit(chunk)).cast("bigint")
    # Most rows are in one chunk only: they need no sequence.
    chunks = F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))
    spread = df.withColumn("_chunk", F.explode(chunks))
    return spread.withColumn("_home", F.col("_chunk") == chunk_of(pos, chunk)).repartition(*keys, "_chunk")


def chunk_window(keys: Sequence[str], pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_home").drop("_chunk", "_home")


def compact_position(
    df: DataFrame, keys: Sequence[str], pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """Renumber ``pos`` without holes after rows were filtered out."""
    rows = df.withColumn("_chunk", chunk_of(pos, chunk)).repartition(*keys, "_chunk")
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    sizes = earlier_sum(sizes, keys, "_chunk", "_n", "_offset", chunk).drop("_n")
    inside = F.row_number().over(chunk_window(keys, pos)) - 1
    ranked = rows.withColumn("_inside", inside).join(sizes, [*keys, "_chunk"])
    position = (F.col("_offset") + F.col("_inside")).cast("bigint")
    return ranked.withColumn(pos, position).drop("_chunk", "_offset", "_inside")


def series_length(df: DataFrame, keys: Sequence[str], name: str = "n_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def with_length(df: DataFrame, keys: Sequence[str], name: str = "n_rows") -> DataFrame:
    return attach(df, series_length(df, keys, name), keys)


def keep_first(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first ``n`` rows of every series, by position."""
    return df.filter(F.col(pos) < n)


def keep_last(df: DataFrame, n: int, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The last ``n`` rows of every series, by position.

    The ends are written first: Spark then knows that they are few, and does not shuffle the rows for them.
    """
    end = settle(df.groupBy(*keys).agg(F.max(pos).alias("_end")))
    return attach(df, end, keys).filter(F.col(pos) > F.col("_end") - n).drop("_end")


def tail_n(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last ``n`` rows of every series of a table without positions.

    While ``n`` is within Spark's group-limit threshold every task forwards at most ``n``
    rows of a series; beyond it the rows are numbered by a range sort first.
    """
    spark = df.sparkSession
    if n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return keep_last(row_position(df, keys, order, "_place"), n, keys, "_place").drop("_place")
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")
