import numpy as np
import pytest
from helpers import START, collected, long_frame, to_spark
from pyspark.sql import functions as F

from tideloom.functions import arrays
from tideloom.functions.calendar import position_sinusoid
from tideloom.operators import sampling, windows
from tideloom.operators.ordering import with_length

KEY = ["series_id"]
SERIES = {"a": np.arange(100.0), "b": np.arange(37.0) * 2, "short": np.arange(11.0)}


def brute(series, context, horizon, stride, first=0, count=None):
    out = set()
    for name, x in series.items():
        w = 0
        while first + w * stride + context + horizon <= len(x) and (count is None or w < count):
            s = first + w * stride
            out.add((name, w, s, tuple(x[s : s + context]), tuple(x[s + context : s + context + horizon])))
            w += 1
    return out


@pytest.mark.parametrize("chunk", [5, 32, 1000])
@pytest.mark.parametrize("stride,first,count", [(1, 0, None), (7, 0, None), (7, 4, 3), (50, 1, None)])
def test_windows_match_brute_force(spark, chunk, stride, first, count):
    df = to_spark(spark, long_frame(SERIES))
    got = windows.cut_windows(df, ["value"], KEY, 8, 4, stride, first, count, chunk=chunk).collect()
    rows = {(r.series_id, r.window_id, r.start, tuple(r.past), tuple(r.future)) for r in got}
    assert len(rows) == len(got)
    assert rows == brute(SERIES, 8, 4, stride, first, count)


def test_strided_count_leaves_out_the_last_window(spark):
    df = with_length(to_spark(spark, long_frame(SERIES)), KEY)
    got = windows.strided_panel_windows(df, KEY, 8, 4, end="n_rows", stride=4).groupBy("series_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": (100 - 12) // 4, "b": (37 - 12) // 4}


def test_multichannel_windows_and_mask(spark):
    frame = long_frame({"a": np.r_[1.0, np.nan, 3.0, 4.0, 5.0]})
    frame["other"] = np.arange(5.0) * 10
    rows = windows.windows_with_time_features(to_spark(spark, frame), ["value", "other"], KEY, 3, 2).collect()
    assert len(rows) == 1
    assert rows[0].past_observed_mask == [1, 0, 1]
    assert [r.other for r in rows[0].past + rows[0].future] == [0.0, 10.0, 20.0, 30.0, 40.0]
    assert rows[0].past[0].weekday_cos == pytest.approx(1.0)


def test_window_scaling_inverse_and_zero_windows(spark):
    frame = long_frame({"a": np.r_[np.arange(12.0), np.zeros(12)], "neg": -np.arange(24.0)})
    cut = windows.cut_windows(to_spark(spark, frame), ["value"], KEY, 4, 2, stride=6)
    scaled = windows.window_mean_scale(cut)
    back = windows.window_mean_unscale(scaled, ["past", "future"])
    raw = {(r.series_id, r.window_id): (r.past, r.future) for r in cut.collect()}
    for r in back.collect():
        np.testing.assert_allclose(r.past, raw[r.series_id, r.window_id][0])
        np.testing.assert_allclose(r.future, raw[r.series_id, r.window_id][1])
    for r in scaled.collect():
        past = np.array(raw[r.series_id, r.window_id][0])
        assert r.divisor == pytest.approx(past.mean() + 1 if past.mean() > 0 else 1.0)
        assert r.std == pytest.approx(past.std(ddof=1))


def test_zero_pad_front(spark):
    frame = long_frame({"short": np.arange(1.0, 4.0), "full": np.arange(6.0), "one": np.array([9.0])}, freq="2h")
    got = collected(windows.zero_pad_front(to_spark(spark, frame), KEY, 6, ["value"]))
    short = got[got["series_id"] == "short"]
    assert short["value"].tolist() == [0, 0, 0, 1, 2, 3]
    assert short["ts"].tolist() == [START + np.timedelta64(2 * (i - 3), "h") for i in range(6)]
    one = got[got["series_id"] == "one"]
    assert len(one) == 6 and one["ts"].isna().sum() == 5
    assert len(got[got["series_id"] == "full"]) == 6 and not got[got["series_id"] == "full"]["padded"].any()


def test_single_step_expand(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], [10.0, 20.0, 30.0, 40.0, 50.0])], "id int, v array<double>, c array<double>")
    rows = windows.single_step_expand(df, "v", 3, ["c"]).orderBy("step").collect()
    assert [r.v for r in rows] == [[1.0, 2.0, -1.0], [2.0, 3.0, -1.0], [3.0, 4.0, -1.0]]
    assert [r.label for r in rows] == [3.0, 4.0, 5.0]
    assert rows[2].c == [30.0, 40.0, 50.0]


def test_patches_drop_the_front(spark):
    df = spark.createDataFrame([([float(i) for i in range(7)],), ([1.0],)], "x array<double>")
    rows = [r[0] for r in df.select(arrays.patches(F.col("x"), 3)).collect()]
    assert rows == [[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], []]


def test_predict_token(spark):
    df = spark.createDataFrame([([1.0, 2.0], [5.0, 6.0], [7.0, 8.0])], "past array<double>, m array<double>, f array<double>")
    row = windows.append_predict_token(df, "past", "m", "f").first()
    assert row.past == [1.0, 2.0, 0.0] and row.m == [5.0, 6.0, 7.0]


def test_pyramid(spark):
    x = np.arange(23.0) ** 2
    df = to_spark(spark, long_frame({"a": x}))
    pyramid = windows.pyramid_pool(df, KEY, (4, 2))
    levels = [x, x[:20].reshape(5, 4).mean(axis=1)]
    levels.append(levels[1][:4].reshape(2, 2).mean(axis=1))
    got = collected(pyramid, ["level", "idx"])
    for level, values in enumerate(levels):
        np.testing.assert_allclose(got[got["level"] == level]["value"], values)
    rows = collected(windows.pyramid_gather(pyramid, KEY, (4, 2)), ["idx"])
    up = [min(i // 4, 4) for i in range(23)]
    np.testing.assert_allclose(rows["value_1"], levels[1][up])
    np.testing.assert_allclose(rows["value_2"], levels[2][[min(i // 2, 1) for i in up]])


def test_position_sinusoid(spark):
    rows = spark.range(50).select("id", position_sinusoid(F.col("id").cast("double"), 6).alias("w")).collect()
    i = np.arange(6)
    for r in rows:
        angle = r["id"] * 10000.0 ** (-2 * (i // 2) / 6)
        np.testing.assert_allclose(r["w"], np.where(i % 2 == 0, np.sin(angle), np.cos(angle)), atol=1e-9)


def test_weighted_draws_follow_the_weights(spark):
    n = 4000
    df = spark.range(n).select(
        F.col("id").alias("row_id"), F.when(F.col("id") == 17, 2000.0).when(F.col("id") % 4 == 0, 0.0).otherwise(-1.0).alias("w")
    )
    got = sampling.weighted_resample(df, "row_id", "w", seed=3)
    rows = {r.row_id: r.draws for r in got.collect()}
    assert sum(rows.values()) == n
    assert not any(i % 4 == 0 for i in rows)
    share = 2000.0 / (2000.0 + 2999)
    assert abs(rows[17] / n - share) < 0.04
    again = {r.row_id: r.draws for r in sampling.weighted_resample(df.repartition(13), "row_id", "w", seed=3).collect()}
    assert again == rows


def test_minibatches_are_a_shuffled_partition(spark):
    df = spark.range(103).withColumnRenamed("id", "row_id")
    rows = sampling.minibatch_assign(df, "row_id", 10, seed=1).collect()
    assert len(rows) == 100 and {r.batch for r in rows} == set(range(10))
    assert len({(r.batch, r.slot) for r in rows}) == 100
    order = [r.row_id for r in sorted(rows, key=lambda r: (r.batch, r.slot))]
    assert order != sorted(order)
    assert sampling.minibatch_assign(df, "row_id", 10, seed=1, drop_last=False).count() == 103


@pytest.mark.parametrize("chunk", [7, 16, 1000])
def test_windows_never_cover_a_missing_position(spark, chunk):
    rng = np.random.default_rng(8)
    frame = long_frame({"a": rng.normal(size=120), "b": rng.normal(size=40)})
    kept = frame[(rng.random(len(frame)) > 0.08) | (frame["pos"] < 2)]
    for stride, first, count in ((1, 0, None), (3, 2, None), (4, 1, 6)):
        got = windows.cut_windows(to_spark(spark, kept), ["value"], KEY, 4, 2, stride, first, count, chunk=chunk).collect()
        want = {}
        for name, part in kept.groupby("series_id"):
            values = dict(zip(part["pos"], part["value"]))
            for number in range(200 if count is None else count):
                start = first + number * stride
                if all(start + i in values for i in range(6)):
                    want[name, number, start] = [values[start + i] for i in range(6)]
        assert {(r.series_id, r.window_id, r.start): [*r.past, *r.future] for r in got} == want and len(got) == len(want)


def test_short_windows_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [5.0, 6.0]), (2, [1.0, 2.0, 3.0, 4.0], [1.0] * 4)], "id int, v array<double>, c array<double>")
    rows = windows.single_step_expand(df, "v", 3, ["c"]).orderBy("id", "step").collect()
    assert [(r.id, r.step, r.label) for r in rows] == [(1, None, None), (2, 0, 2.0), (2, 1, 3.0), (2, 2, 4.0)]
    assert rows[0].v == [1.0, 2.0] and rows[0].c == [5.0, 6.0]


def test_pyramid_has_mean_and_peak_of_whole_groups(spark):
    x = np.random.default_rng(1).normal(size=70)
    got = windows.pyramid_levels(to_spark(spark, long_frame({"a": x})), KEY, (4, 2)).toPandas()
    for level, span in enumerate((1, 4, 8)):
        part = got[got["level"] == level].sort_values("idx")
        whole = x[: len(x) // span * span].reshape(-1, span)
        np.testing.assert_allclose(part["mean"], whole.mean(axis=1), atol=1e-12)
        np.testing.assert_allclose(part["peak"], whole.max(axis=1))


def test_draws_do_not_depend_on_the_scale_of_weights(spark):
    rng = np.random.default_rng(3)
    weights = rng.random(300) * 2e-7
    draws = []
    for factor in (1.0, 2.0**40, 1e9):
        rows = [(i, float(w * factor)) for i, w in enumerate(weights)] + [(1000, None), (1001, float("nan")), (1002, 0.0), (1003, float("inf"))]
        got = sampling.weighted_resample(spark.createDataFrame(rows, "row_id long, w double"), "row_id", "w", seed=3).collect()
        draws.append({r.row_id: r.draws for r in got})
        assert sum(draws[-1].values()) == 304 and max(draws[-1]) < 1000
    assert draws[0] == draws[1] == draws[2]
    nothing = spark.createDataFrame([(1, 0.0), (2, None)], "row_id long, w double")
    assert sampling.weighted_draws(nothing, "row_id", "w").collect() == []
