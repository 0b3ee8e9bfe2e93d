"""Session settings and the shared folder that holds checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tideloom


def configure(spark: SparkSession) -> SparkSession:
    """Prepare a session: naive timestamps are UTC, and tasks carry the package's functions.

    Pickling the package by value means executors need not have it installed.
    """
    cloudpickle.register_pickle_by_value(tideloom)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tideloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The plan starts anew at the written files: a lost executor costs only its own reads,
    columns and row groups that a later step does not need are skipped, and Spark knows the
    size of what it joins.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
