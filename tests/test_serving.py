import numpy as np
import pandas as pd
import pytest
from helpers import arma, long_frame, to_spark
from pyspark.sql import functions as F

from tideloom.models import arima, serving
from tideloom.session import fresh_path
from tideloom.sources import store

KEY = ["series_id"]


@pytest.fixture
def series():
    return {"a": arma(300, 0.6, seed=1) + 5, "b": np.cumsum(arma(200, 0.3, seed=2)), "tiny": np.array([1.0, 2.0])}


def families(fits):
    built = {
        "ar1": serving.ar1_family(),
        "arima": serving.arima_family((1, 1, 1), gate=False),
        "sarimax": serving.sarimax_family(((1, 0, 0), (0, 0, 0)), ((0, 1, 0, 24),)),
        "window": serving.window_family(6, 3),
    }

    def counting(name, family):
        def fit(rows, keys):
            fits.append((name, sorted(r.series_id for r in rows.select("series_id").distinct().collect())))
            return family.fit(rows, keys)

        return serving.Family(fit, family.forecast)

    return {name: counting(name, family) for name, family in built.items()}


def asked(spark, rows):
    return spark.createDataFrame(rows, "request_id int, series_id string, model string, horizon int")


def test_requests_go_to_every_family(spark, series):
    df, path, fits = to_spark(spark, long_frame(series)), fresh_path(spark, "store"), []
    requests = [
        (1, "a", "ar1", 1), (2, "a", "ar1", 30), (3, "a", "arima", 5), (4, "b", "arima", 2), (5, "b", "sarimax", 40),
        (6, "a", "window", 3), (7, "a", "window", 4), (8, "tiny", "window", 1), (9, "tiny", "arima", 1), (10, "zz", "ar1", 1),
        (11, "a", "oracle", 1), (12, "a", "ar1", 0), (13, None, "ar1", 1), (14, "a", None, 1), (15, "a", "ar1", None), (2, "a", "ar1", 30),
    ]
    got = serving.answer_requests(asked(spark, requests), df, families(fits), path).collect()
    assert len(got) == len(requests)
    by = {r.request_id: r for r in got}
    assert {i for i, r in by.items() if r.status == "result"} == {1, 2, 3, 4, 5, 6}
    errors = {i: r.error for i, r in by.items() if r.status == "error"}
    assert errors[7] == "no forecast at this horizon" and errors[8] == "no model: failed: too few rows"
    assert errors[9].startswith("no model: failed") and errors[10] == errors[13] == "unknown series"
    assert errors[11] == errors[14] == "no such model" and errors[12] == errors[15] == "horizon must be positive"
    assert all(r.ts is None and r.yhat is None for r in got if r.status == "error")
    assert by[2].ts == pd.Timestamp("2024-01-01") + pd.Timedelta(hours=299 + 30)
    want = {r.step: r.yhat for r in arima.arima_forecast(df, arima.arima_fit(df, KEY, (1, 1, 1), gate=False), KEY, 5).where("series_id = 'a'").collect()}
    assert by[3].yhat == pytest.approx(want[5], rel=1e-9)
    assert dict(fits) == {"ar1": ["a"], "arima": ["a", "b", "tiny"], "sarimax": ["b"], "window": ["a", "tiny"]}


def test_only_missing_models_are_fitted(spark, series):
    df, path, fits = to_spark(spark, long_frame(series)), fresh_path(spark, "store"), []
    built = families(fits)
    first = serving.answer_requests(asked(spark, [(1, "a", "ar1", 2)]), df, built, path).collect()
    again = serving.answer_requests(asked(spark, [(1, "a", "ar1", 2), (2, "b", "ar1", 2)]), df, built, path).collect()
    assert fits == [("ar1", ["a"]), ("ar1", ["b"])]
    assert {r.request_id: r.yhat for r in again}[1] == first[0].yhat
    assert store.load_models(spark, path).count() == 2
    assert serving.answer_requests(asked(spark, []), df, built, path).collect() == []
    # A newer fit replaces the stored one, and answers come from it once.
    newer = store.load_models(spark, path).where("series_id = 'a'").drop("version").withColumn("level", F.lit(100.0))
    store.save_models(newer, path)
    (answer,) = serving.answer_requests(asked(spark, [(1, "a", "ar1", 1)]), df, built, path).collect()
    assert answer.yhat > first[0].yhat + 10
