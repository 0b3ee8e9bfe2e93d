"""Reading series from CSV files and dense arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Time column and channels of the main hourly file and of tool requests.
MAIN_TIME = "date"
MAIN_CHANNELS = ["HUFL", "HULL", "MUFL", "MULL", "LUFL", "LULL", "OT"]
# Columns of the headerless panel file.
PANEL_SCHEMA = "app_name STRING, zone STRING, time TIMESTAMP_NTZ, value DOUBLE"


def csv_scan(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """CSV with a header and a declared schema (nothing is inferred)."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(paths)


def csv_multi_union(spark: SparkSession, files: dict[str, str | T.StructType], sep: str = ",") -> DataFrame:
    """Stack files by column name; a column one file lacks is NULL there."""
    parts = [csv_scan(spark, path, schema, sep) for path, schema in files.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def csv_locale(
    spark: SparkSession, path: str, index: str, channels: Sequence[str], sep: str = ";"
) -> DataFrame:
    """Semicolon-separated text numbers with a decimal comma; the first column is the time."""
    schema = T.StructType(
        [T.StructField(index, T.TimestampNTZType())] + [T.StructField(c, T.StringType()) for c in channels]
    )
    rows = csv_scan(spark, path, schema, sep)
    numbers = {c: F.regexp_replace(c, ",", ".").try_cast("double") for c in channels}
    return rows.withColumns(numbers)


def csv_headerless(spark: SparkSession, path: str, schema: str = PANEL_SCHEMA, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", False).option("sep", sep).csv(path)


def panel_array_scan(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One array per series to ``keys, pos, value, cov_1…``.

    The array holds numbers (value only) or arrays of numbers whose first entry is the value
    and the rest are covariates.
    """
    rows = df.select(*keys, F.posexplode(column).alias("pos", "_cell"))
    if not isinstance(df.schema[column].dataType.elementType, T.ArrayType):
        return rows.select(*keys, "pos", F.col("_cell").cast("double").alias("value"))
    return rows.select(
        *keys,
        "pos",
        F.get("_cell", 0).cast("double").alias("value"),
        F.transform(F.slice("_cell", 2, F.greatest(F.size("_cell") - 1, F.lit(0))), lambda v: v.cast("double")).alias("covariates"),
    )


def typed_ingest(
    df: DataFrame,
    time_column: str = MAIN_TIME,
    channels: Sequence[str] = tuple(MAIN_CHANNELS),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Untyped text rows to a typed table, with ``error`` naming the columns that do not parse.

    Rows are never dropped: a bad cell becomes NULL and is named. A series key must be present.
    """
    stamp = F.try_to_timestamp(F.col(time_column)).cast("timestamp_ntz")
    typed = {time_column: stamp, **{c: F.col(c).try_cast("double") for c in channels}}
    bad = [F.when(value.isNull() & F.col(c).isNotNull(), F.lit(c)) for c, value in typed.items()]
    bad += [F.when(F.col(c).isNull(), F.lit(c)) for c in (*keys, time_column)]
    error = F.concat_ws(",", *bad)
    others = [F.col(c) for c in df.columns if c not in typed]
    return df.select(
        *others,
        *[value.alias(c) for c, value in typed.items()],
        F.when(error != "", error).alias("error"),
    )
