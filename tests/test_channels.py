import pytest
from pyspark.sql import functions as F

from tideloom.operators.panel import OTHER, as_channels, channel_names
from tideloom.plans import QUERIES
from tideloom.session import fresh_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    """The events of the test tables, a tenth of the clicks of a type that they do not have."""
    path = fresh_path(spark, "tables")
    rows = spark.read.parquet(f"{SF}/events.parquet")
    odd = (F.col("event_type") == "click") & (F.col("event_id") % 10 == 0)
    rows.withColumn("event_type", F.when(odd, "re.fund").otherwise(F.col("event_type"))).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["csv_scan", "csv_multi_union", "csv_locale", "column_roles", "require_columns", "numeric_cast", "iqr_filter"])
def test_an_unknown_type_has_a_column(spark, folder, name):
    rows = QUERIES[name](spark, folder)
    assert "re_fund" in rows.columns and rows.where("re_fund IS NOT NULL").count() > 0


def test_an_unknown_type_has_features_and_rows(spark, folder):
    assert {"re_fund", "re_fund_lag1", "re_fund_rolling_std"} <= set(QUERIES["feature_matrix"](spark, folder).columns)
    rows = QUERIES["panel_pivot"](spark, folder)
    assert rows.where("series_id = 're_fund' AND value IS NOT NULL").count() > 0


def test_names_are_bounded_and_the_rest_is_kept(spark):
    rows = [("a", 1.0)] * 3 + [("b", 2.0)] * 2 + [("c", 4.0), (None, 8.0), ("d", 16.0)]
    df = spark.createDataFrame(rows, "series_id string, value double")
    names = channel_names(df, limit=2)
    assert names == ["a", "b", OTHER] and channel_names(df, limit=9) == ["a", "b", "c", "d", OTHER]
    assert channel_names(df.where("series_id < 'c'")) == ["a", "b"]
    sums = as_channels(df, names).groupBy("series_id").agg(F.sum("value").alias("v"))
    assert {r.series_id: r.v for r in sums.collect()} == {"a": 3.0, "b": 4.0, OTHER: 28.0}
    assert channel_names(df.limit(0)) == []
