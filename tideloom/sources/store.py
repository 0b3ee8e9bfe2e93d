"""Writing forecasts and keeping fitted models."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_forecasts(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = "model") -> None:
    """Forecast table to parquet or CSV, in one folder per model."""
    writer = df.write.mode("errorifexists")
    if partition is not None:
        writer = writer.partitionBy(partition)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


#: Error conditions of a store, or a part of it, that nothing has been written to yet.
_ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def _read(spark: SparkSession, path: str, **options) -> DataFrame | None:
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in _ABSENT:
            return None
        raise


def save_models(models: DataFrame, path: str) -> int:
    """Write model rows (``keys, model``, parameters, scores) as the next version of the store.

    The rows go to a folder of their own under ``rows``. One row in ``commits``, written after
    them as a single file, makes them visible: a write that dies before that leaves folders that no
    reader looks at, and none ever sees half of one. Returns the version. Writers at the same time
    get the same version and are ordered by the names of their writes.
    """
    spark = models.sparkSession
    write = f"w-{uuid.uuid4().hex}"
    models.withColumn("write", F.lit(write)).write.mode("append").partitionBy("write", "model").parquet(f"{path}/rows")
    commits = _read(spark, f"{path}/commits")
    version = 1 if commits is None else (commits.agg(F.max("version")).first()[0] or 0) + 1
    mark = spark.range(1).select(F.lit(write).alias("write"), F.lit(version).cast("long").alias("version"))
    mark.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def stored_models(
    spark: SparkSession, path: str, keys: Sequence[str] = ("series_id",), model: str | None = None, as_of: int | None = None
) -> DataFrame | None:
    """The newest committed row of every series and model, with its ``version``; None without any.

    ``as_of`` names a version: later ones are left out. Rows of families with different columns
    share one table; what a family does not have is NULL. Within one write the rows of a series and
    model must be unique.
    """
    commits, rows = _read(spark, f"{path}/commits"), _read(spark, f"{path}/rows", mergeSchema=True)
    if commits is None or rows is None:
        return None
    if as_of is not None:
        commits = commits.where(F.col("version") <= as_of)
    rows = rows.withColumn("model", F.col("model").cast("string"))
    if model is not None:
        rows = rows.where(F.col("model") == model)
    rest = [c for c in rows.columns if c not in (*keys, "model", "write")]
    newest = F.max_by(F.struct(*rest, "version"), F.struct("version", "write")).alias("_newest")
    return rows.join(commits, "write").groupBy(*keys, "model").agg(newest).select(*keys, "model", "_newest.*")


def load_models(
    spark: SparkSession, path: str, model: str | None = None, keys: Sequence[str] = ("series_id",), as_of: int | None = None
) -> DataFrame:
    """``stored_models`` of a store that must have some."""
    models = stored_models(spark, path, keys, model, as_of)
    if models is None:
        raise FileNotFoundError(f"no models are committed in {path}")
    return models


def fit_missing(wanted: DataFrame, models: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The ``keys, model`` pairs that have no stored model yet."""
    on = [*keys, "model"]
    return wanted if models is None else wanted.join(models.select(*on), on, "left_anti")
