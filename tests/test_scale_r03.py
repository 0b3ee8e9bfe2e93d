"""Steps that failed or slowed on larger tables: joins of generated rows, short series in bulk."""

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import START, arma, collected, long_frame, to_spark
from pyspark.sql import functions as F

from tideloom.functions.times import HOUR
from tideloom.llm import simhash
from tideloom.models import arima, backtest, moments, scan, serving
from tideloom.models.arima import NO_SEASON, filter_reach, fit_orders
from tideloom.models.moments import SeriesMoments, lag_moments
from tideloom.models.solve import ArmaShape, adf_statistic, inverse_series
from tideloom.operators import panel, windows
from tideloom.operators.evaluation import gaussian_nll, masked_abs_error
from tideloom.operators.ordering import keep_last
from tideloom.operators.panel import dense_grid

KEY = ["series_id"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("score", [gaussian_nll, masked_abs_error, lambda df: df.filter("label <> 0")])
def test_a_filtered_grid_is_never_broadcast(spark, score):
    rows = to_spark(spark, long_frame({"a": arma(50), "b": arma(50, seed=1)}).drop(columns="pos"))
    grid = dense_grid(rows, KEY, HOUR).select(*KEY, F.col("value").alias("label"), F.lit(0.0).alias("mu"), F.lit(1.0).alias("sigma"))
    assert "BroadcastHashJoin" not in plan(score(grid))


def test_fingerprint_variants_are_never_broadcast(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(simhash, "settle", lambda df: joined.append(plan(df)) or df)
    simhash.hamming_links(spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long"), 2)
    assert "SortMergeJoin" in joined[0] and "BroadcastHashJoin" not in joined[0]


def test_models_without_a_moving_average_need_no_incoming_states(spark, monkeypatch):
    """They look back on no residuals, so no pass is made for the states ahead of their chunks."""
    rows = to_spark(spark, long_frame({"a": np.cumsum(arma(300, 0.5)), "b": np.cumsum(arma(300, 0.2, seed=3))}))
    orders = [((1, 1, 0), NO_SEASON)]
    whole = collected(fit_orders(rows, KEY, orders, "m"), ["series_id"])

    def refuse(self, trials):
        raise AssertionError("no state is carried")

    monkeypatch.setattr(scan.Scan, "incoming", refuse)
    cut = collected(fit_orders(rows, KEY, orders, "m", chunk=64), ["series_id"])
    assert list(cut["status"]) == ["ok", "ok"]
    assert np.allclose([p[0] for p in cut["params"]], [p[0] for p in whole["params"]], atol=1e-8)
    assert np.allclose(cut["sigma2"], whole["sigma2"])


def test_search_without_a_moving_average_keeps_the_terms_it_has():
    assert filter_reach((1, 1, 0), NO_SEASON, 128) == 1
    assert filter_reach((1, 0, 0), (0, 1, 0, 24), 128) == 1
    assert filter_reach((2, 0, 0), (1, 0, 0, 24), 128) == 26
    assert filter_reach((1, 1, 1), NO_SEASON, 128) == 128


def test_lag_moments_of_one_and_of_several_chunks_agree(spark):
    series = {"one": arma(40), "exact": arma(64, seed=2), "two": arma(65, seed=3), "many": arma(300, seed=4), "tiny": arma(3, seed=5)}
    frame = long_frame(series).assign(other=lambda f: f["value"] ** 2)
    table = {r["series_id"]: r for r in lag_moments(to_spark(spark, frame), ["value", "other"], KEY, 10, chunk=64).collect()}
    assert set(table) == set(series)
    for name, x in series.items():
        direct, row = SeriesMoments.of(np.array([x, x**2]), 10), table[name]
        found = SeriesMoments(row["n"], row["sums"], row["moments"], row["head"], row["tail"])
        assert found.n == len(x)
        for field in ("sums", "moments", "head", "tail"):
            assert np.allclose(getattr(found, field), getattr(direct, field)), (name, field)


def test_lag_moments_leave_out_rows_without_a_key(spark):
    rows = to_spark(spark, long_frame({"a": arma(20), "b": arma(20, seed=1)})).withColumn("series_id", F.expr("nullif(series_id, 'b')"))
    assert [r["series_id"] for r in lag_moments(rows, ["value"], KEY, 2).collect()] == ["a"]


def test_lag_moments_call_python_once_a_task_not_once_a_chunk(spark):
    rows = to_spark(spark, long_frame({"a": arma(40)}))
    halo_calls = []
    original = moments.settle
    try:
        moments.settle = lambda df: halo_calls.append(plan(df)) or original(df)
        lag_moments(rows, ["value"], KEY, 4)
    finally:
        moments.settle = original
    assert any("MapInArrow" in p for p in halo_calls) and not any("FlatMapGroups" in p for p in halo_calls)


def test_backtest_products_are_added_as_arrays(spark):
    rows = to_spark(spark, long_frame({"a": arma(200)}))
    out = backtest.backtest(rows, [backtest.Autoregression(1), backtest.Repeat(24)], KEY, 24, chunk=64)
    assert "FlatMapGroups" not in plan(out)


def test_runs_of_rows_go_on_in_the_next_batch():
    import pyarrow as pa

    keys, place = [None, None, 1, 1, 1, 2], [0, 1, 0, 1, 2, 0]
    table = pa.table({"k": pa.array(keys, pa.int64()), "pos": place})
    found = list(moments.chunk_groups(iter(table.to_batches(max_chunksize=2)), ["k"], ["pos"]))
    assert [(k, list(v["pos"])) for (k,), v in found] == [(None, [0, 1]), (1, [0, 1, 2]), (2, [0])]


def test_nested_regressions_choose_as_single_ones(monkeypatch):
    for seed in range(5):
        x = np.cumsum(arma(300, 0.6, 0.3, seed=seed))
        level = x - x.mean()
        table = SeriesMoments.of(np.array([level, np.concatenate([[0.0], np.diff(level)])]), 13)
        fast = adf_statistic(table, 12)
        with monkeypatch.context() as m:
            m.setattr(np.linalg, "cholesky", lambda a: (_ for _ in ()).throw(np.linalg.LinAlgError))
            plain = adf_statistic(table, 12)
        assert fast[1:] == plain[1:] and np.isclose(fast[0], plain[0])


def test_geometric_series_of_a_single_term():
    assert np.allclose(inverse_series(np.array([1.0, 0.5, 0, 0])), [1, -0.5, 0.25, -0.125])
    assert np.allclose(inverse_series(np.array([1.0, 0, -0.5, 0, 0])), [1, 0, 0.5, 0, 0.25])
    assert np.allclose(inverse_series(np.array([1.0, 0, 0])), [1, 0, 0])
    assert ArmaShape((0, 0, 1)).filter(np.array([0.5]), 3).tolist() == [1, -0.5, 0.25, -0.125]


def test_windows_are_cut_from_plain_arrays(spark):
    """No struct of a chunk's rows is taken apart again for every window."""
    rows = to_spark(spark, long_frame({"a": np.arange(40.0)})).withColumn("double", F.col("value") * 2)
    cut = windows.cut_windows(rows, ["value", "double"], KEY, 3, 2, chunk=16)
    assert [f.name for f in cut.schema["past"].dataType.elementType.fields] == ["value", "double"]
    above = plan(cut).split("Generate")[0]
    assert "lambdafunction" not in above
    first = cut.where("window_id = 20").first()
    assert [tuple(r) for r in first["past"]] == [(20.0, 40.0), (21.0, 42.0), (22.0, 44.0)]
    assert [tuple(r) for r in first["future"]] == [(23.0, 46.0), (24.0, 48.0)]


def test_the_ticks_of_a_grid_are_not_joined(spark):
    rows = to_spark(spark, long_frame({"a": arma(50), "b": arma(50, seed=1)}).drop(columns="pos"))
    above, *_ = plan(dense_grid(rows, KEY, HOUR)).split("Generate")
    assert not any(step in above for step in ("Join", "Exchange", "Sort"))


@pytest.mark.parametrize("block", [4, 4096])
def test_a_grid_keeps_shared_ticks_and_leaves_out_rows_without_a_place(spark, monkeypatch, block):
    monkeypatch.setattr(panel, "GRID_BLOCK", block)
    rows = [("a", 0, 1.0), ("a", 4, 2.0), ("a", 4, 3.0), ("b", 9, None), (None, 3, 5.0), ("c", None, 6.0), ("b", 2, 7.0)]
    df = spark.createDataFrame([(k, None if h is None else START.to_pydatetime() + timedelta(hours=h), v) for k, h, v in rows], "series_id string, ts timestamp_ntz, value double")
    off = spark.createDataFrame([("b", START.to_pydatetime() + timedelta(hours=5, minutes=1), 8.0)], df.schema)
    got = [(r["series_id"], r["pos"], r["value"]) for r in dense_grid(df.union(off), KEY, HOUR, fill=None).collect()]
    found = {("a", 0): [1.0], ("a", 4): [2.0, 3.0], ("b", 2): [7.0]}
    expected = [(k, pos, v) for k in ("a", "b", "c", None) for pos in range(10) for v in found.get((k, pos), [None])]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    filled = [r["value"] for r in dense_grid(df.union(off), KEY, HOUR).collect()]
    assert len(filled) == 41 and sum(filled) == 13.0


@pytest.mark.parametrize("near", [0, 4096])
def test_gathered_base_rows_are_joined_by_their_place_alone(spark, monkeypatch, near):
    """Levels that end early, a long way behind, with a hole, or that a series does not have."""
    sizes, pyramid = {"a": (23, 5, 1), "b": (90, 2, 1), "c": (3, 0, 0), None: (8, 2, 1)}, []
    for key, counts in sizes.items():
        pyramid += [(key, level, idx, 100.0 * level + idx) for level, n in enumerate(counts) for idx in range(n) if (key, level, idx) != ("a", 1, 2)]
    df = spark.createDataFrame(pyramid, "series_id string, level int, idx long, value double")
    monkeypatch.setattr(windows, "STAND_INS", near, raising=False)
    joined = []
    keep = windows.attach
    monkeypatch.setattr(windows, "attach", lambda df, *rest: joined.append(df.columns) or keep(df, *rest))
    got = {(r["series_id"], r["idx"]): (r["value_0"], r["value_1"], r["value_2"]) for r in windows.pyramid_gather(df, KEY, (4, 2)).collect()}
    assert not near or not joined
    expected = {}
    for key, (n, one, two) in sizes.items():
        for i in range(n):
            up = min(i // 4, one - 1)
            known = key is not None and one and (key, up) != ("a", 2)
            expected[key, i] = (float(i), 100.0 + up if known else None, 200.0 + min(up // 2, two - 1) if known else None)
    assert got == expected


def test_last_rows_are_found_without_a_shuffle_of_all(spark):
    rows = to_spark(spark, long_frame({"a": arma(50), "b": arma(30, seed=1)})).select(*KEY, "pos", "value")
    newest = keep_last(rows, 3, KEY)
    assert "SortMergeJoin" not in plan(newest)
    assert collected(newest)["pos"].tolist() == [47, 48, 49, 27, 28, 29]


@pytest.mark.parametrize("chunk", [None, 64])
def test_a_fit_reads_the_ends_of_its_series_with_their_blocks(spark, monkeypatch, chunk):
    monkeypatch.setattr(arima, "_ends", lambda *given: pytest.fail("a pass for the ends alone"))
    series = {"a": np.cumsum(arma(128, 0.5)), "b": np.cumsum(arma(65, 0.2, seed=3))}
    rows = long_frame(series)
    for r in fit_orders(to_spark(spark, rows), KEY, [((1, 1, 0), NO_SEASON)], "m", chunk=chunk).collect():
        assert np.array_equal(r["tail"], [series[r["series_id"]][-2:]])
        assert r["last"] == rows[rows["series_id"] == r["series_id"]]["ts"].max()


@pytest.mark.parametrize("chunk", [8, 8192])
def test_first_order_models_and_their_ends_come_from_one_pass(spark, monkeypatch, chunk):
    rows = to_spark(spark, long_frame({"a": arma(50, 0.5), "b": arma(30, 0.2, seed=1), "one": np.array([2.0])}))
    apart = collected(arima.ar1_ends(rows, arima.ar1_fit(rows, KEY, chunk=chunk), KEY), KEY)
    monkeypatch.setattr(arima, "ar1_ends", lambda *given: pytest.fail("a pass for the ends alone"))
    fitted = serving.ar1_family(chunk=chunk).fit(rows, KEY)
    assert list(collected(fitted, KEY)["status"]) == ["ok", "ok", "failed: too few rows"]
    pd.testing.assert_frame_equal(collected(fitted.select(*apart.columns), KEY), apart)
