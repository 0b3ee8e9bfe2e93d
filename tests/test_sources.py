import pytest

from tideloom.session import fresh_path
from tideloom.sources import files, store


def write(spark, lines, name="text"):
    path = fresh_path(spark, name)
    spark.createDataFrame([(line,) for line in lines], "line string").coalesce(1).write.text(path)
    return path


def test_csv_scan_and_union(spark):
    first = write(spark, ["date,a,b", "2018-06-22 16:00:00,4.22,2.9", "2018-06-22 17:00:00,,1.5"])
    second = write(spark, ["date,a,c", "2018-06-23 16:00:00,1.0,7.5"])
    rows = files.csv_scan(spark, first, "date TIMESTAMP_NTZ, a DOUBLE, b DOUBLE").orderBy("date").collect()
    assert [r.a for r in rows] == [4.22, None] and rows[0].date.hour == 16
    both = files.csv_multi_union(
        spark,
        {first: "date TIMESTAMP_NTZ, a DOUBLE, b DOUBLE", second: "date TIMESTAMP_NTZ, a DOUBLE, c DOUBLE"},
    )
    assert both.columns == ["date", "a", "b", "c"] and both.count() == 3
    assert both.filter("c = 7.5 AND b IS NULL").count() == 1


def test_csv_locale(spark):
    path = write(spark, ['"";"MT_1";"MT_2"', "2011-01-01 00:15:00;3,5;0", "2011-01-01 00:30:00;-1,25;12"])
    rows = files.csv_locale(spark, path, "ts", ["MT_1", "MT_2"]).orderBy("ts").collect()
    assert [(r.MT_1, r.MT_2) for r in rows] == [(3.5, 0.0), (-1.25, 12.0)]


def test_csv_headerless(spark):
    path = write(spark, ["app,zone1,2024-01-01 00:00:00,1.5", "app,zone2,2024-01-01 01:00:00,2"])
    rows = files.csv_headerless(spark, path).orderBy("time").collect()
    assert [(r.app_name, r.zone, r.value) for r in rows] == [("app", "zone1", 1.5), ("app", "zone2", 2.0)]


def test_panel_arrays(spark):
    flat = spark.createDataFrame([("a", [1.0, 2.0])], "series_id string, x array<double>")
    assert [(r.pos, r.value) for r in files.panel_array_scan(flat, ["series_id"], "x").collect()] == [(0, 1.0), (1, 2.0)]
    deep = spark.createDataFrame([("a", [[1.0, 5.0, 6.0], [2.0, 7.0, 8.0], [3.0]])], "series_id string, x array<array<double>>")
    rows = files.panel_array_scan(deep, ["series_id"], "x").orderBy("pos").collect()
    assert [(r.value, r.covariates) for r in rows] == [(1.0, [5.0, 6.0]), (2.0, [7.0, 8.0]), (3.0, [])]


def test_typed_ingest_names_bad_cells(spark):
    text = [("s", "2024-01-01 00:00:00", "1.5", None), ("s", "soon", "x", "2"), (None, "2024-01-01", "1", "2")]
    df = spark.createDataFrame(text, "series_id string, date string, a string, b string")
    rows = files.typed_ingest(df, "date", ["a", "b"], ["series_id"]).collect()
    assert [r.error for r in rows] == [None, "date,a", "series_id"]
    assert rows[0].a == 1.5 and rows[0].b is None and rows[1].b == 2.0


def test_store_round_trip(spark):
    models = spark.createDataFrame(
        [("a", "arima", [0.5], 1.0), ("b", "arima", None, None)], "series_id string, model string, params array<double>, aic double"
    )
    path = fresh_path(spark, "models")
    store.save_models(models, path)
    store.save_models(models.limit(1).selectExpr("series_id", "'ar1' AS model", "params", "aic"), path)
    loaded = store.load_models(spark, path)
    assert loaded.count() == 3 and store.load_models(spark, path, "ar1").first().params == [0.5]
    wanted = spark.createDataFrame([("a", "arima"), ("c", "arima"), ("b", "ar1")], "series_id string, model string")
    assert {tuple(r) for r in store.fit_missing(wanted, loaded, ["series_id"]).collect()} == {("c", "arima"), ("b", "ar1")}


def test_newest_version_wins_and_unfinished_writes_are_invisible(spark):
    path = fresh_path(spark, "models")
    assert store.stored_models(spark, path) is None
    with pytest.raises(FileNotFoundError):
        store.load_models(spark, path)
    rows = lambda phi: spark.createDataFrame([("a", "ar1", phi), ("b", "ar1", phi)], "series_id string, model string, phi double")
    assert store.save_models(rows(0.1), path) == 1
    assert store.save_models(rows(0.2).where("series_id = 'a'"), path) == 2
    # A write that died before its commit.
    rows(9.0).selectExpr("*", "'w-dead' AS write").write.mode("append").partitionBy("write", "model").parquet(f"{path}/rows")
    got = {r.series_id: (r.phi, r.version) for r in store.load_models(spark, path).collect()}
    assert got == {"a": (0.2, 2), "b": (0.1, 1)}
    assert {r.phi for r in store.load_models(spark, path, as_of=1).collect()} == {0.1}
    other = spark.createDataFrame([("a", "window", [1.0])], "series_id string, model string, coefs array<double>")
    assert store.save_models(other, path) == 3
    every = {(r.series_id, r.model): (r.phi, r.coefs) for r in store.load_models(spark, path).collect()}
    assert every == {("a", "ar1"): (0.2, None), ("b", "ar1"): (0.1, None), ("a", "window"): (None, [1.0])}
    assert store.load_models(spark, path, "window").count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_forecast_sink(spark, fmt):
    rows = spark.createDataFrame([("a", 1, 2.5, "m1"), ("a", 1, 3.5, "m2")], "series_id string, step int, yhat double, model string")
    path = fresh_path(spark, "forecasts")
    store.write_forecasts(rows, path, fmt)
    reader = spark.read.schema(rows.schema).option("header", True)
    back = reader.format(fmt).load(path).select(*rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
