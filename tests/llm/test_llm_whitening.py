import math

import numpy as np

from tideloom.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def result(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(5)
    return whiten(df, **options).toPandas().sort_values(["vec_id", "component"]).reset_index(drop=True)


def brute(rows, count=16):
    """Fit list, components and digest columns by exact sums and a plain eigendecomposition."""
    sound = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in sound})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(dev.T @ dev / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    live = values > 1e-13 * values[0]
    values, vectors, trace = values[live][:count], vectors[:, live][:, :count], values.sum()
    out = {}
    for i, x in sound:
        d = [n * a - s for a, s in zip(x, sums)]
        out[i] = (n, sum(v * v for v in d), (np.array(d, float) / n) @ vectors / np.sqrt(values), values / trace)
    return out


def compare(got, rows, tolerance=1e-8, exact=1e-8):
    want = brute(rows)
    assert set(got["vec_id"]) == set(want)
    signs = None
    for i, part in got.groupby("vec_id"):
        n, deviation, whitened, explained = want[i]
        part = part.drop_duplicates("component")
        assert part["component"].tolist() == list(range(1, len(whitened) + 1))
        assert set(part["n"]) == {n} and set(part["deviation"]) == {deviation}
        np.testing.assert_allclose(part["explained"], explained, rtol=exact)
        np.testing.assert_allclose(np.abs(part["whitened"]), np.abs(whitened), rtol=0, atol=tolerance * 100)
        if signs is None:
            signs = np.sign(part["whitened"].to_numpy()) * np.sign(whitened)
        clear = np.abs(whitened) > 1e-3
        assert (np.sign(part["whitened"].to_numpy()) == np.sign(whitened) * signs)[clear & (signs != 0)].all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-6


def scaled(n, d, seed=0, spread=3.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    scales = np.logspace(spread / 2, -spread / 2, d)
    return [(i, [float(c) for c in (rng.normal(size=d) * scales) @ mix]) for i in range(n)]


def test_equals_a_plain_eigendecomposition(spark):
    rows = scaled(400, 24)
    got = result(spark, rows)
    compare(got, rows)
    assert len(got) == 400 * 16


def test_badly_scaled_columns(spark):
    rng = np.random.default_rng(3)
    scales = np.array([1e4, 1e3, 1e2, 1.0, 0.1])
    rows = [(i, (rng.normal(size=5) * scales).tolist()) for i in range(300)]
    got = result(spark, rows)
    assert got["identity_error"].iloc[0] < 1e-6
    compare(got, rows, 1e-5, exact=1e-5)


def test_copies_count_once_in_the_fit(spark):
    rows = scaled(50, 4, 1)
    rows += [(100 + i, rows[0][1]) for i in range(300)]
    compare(result(spark, rows), rows)


def test_dependent_directions_are_no_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-200, 200, size=(60, 3)) / 64
    rows = [(i, [a, b, a + b, c, 0.5]) for i, (a, b, c) in enumerate(base.tolist())]
    got = result(spark, rows)
    assert got["component"].max() == 3
    compare(got, rows)


def test_fewer_rows_than_dimensions(spark):
    rows = scaled(5, 12, 5, 1.0)
    got = result(spark, rows)
    assert got["component"].max() == 4
    compare(got, rows)


def test_edge_cases(spark):
    rows = scaled(30, 3, 2)
    odd = [
        (900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0]), (903, [1.0, float("inf"), 2.0]),
        (904, [1.0, -float("inf"), 2.0]), (905, [3e38, 1.0, 1.0]), (906, []), (907, [1.0, 2.0]),
    ]
    got = result(spark, rows + odd)
    compare(got, rows)
    repeated = result(spark, rows + rows)
    assert len(repeated) == 2 * len(got)
    compare(repeated, rows)
    wide = [(*r, 1, "x", 2.0) for r in rows + odd]
    compare(result(spark, wide, SCHEMA + ", n int, component string, whitened double"), rows)
    assert len(result(spark, [(None, v) for _, v in rows])) == len(got)
    for empty in ([], odd[:7], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert result(spark, empty).empty


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i) * 2**40, 1.0]) for i in range(5)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = whiten(df).toPandas()
    assert not got["deviation"].isna().all()
    assert got.loc[got["vec_id"] == 0, "deviation"].isna().all()
    assert got["whitened"].notna().all()
