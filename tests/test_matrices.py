"""Constructors, slices and axis variants against NumPy; estimators with hard numbers; streams of paths."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import construct, forecast, matrix, ordered, random, recurrences, reduce, regression, relational, simulation
from millrace.sources import csv


def cells(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def a():
    return np.random.default_rng(3).integers(-5, 6, (5, 7)).astype(float)


def test_constructors(spark):
    np.testing.assert_array_equal(dense(construct.tabulate(spark, 3, 4, lambda i, j: i * 10 + j), (3, 4)), np.fromfunction(lambda i, j: i * 10 + j, (3, 4)))
    np.testing.assert_array_equal(dense(construct.full(spark, 2, 3, 2.5), (2, 3)), np.full((2, 3), 2.5))
    for k in (-2, 0, 3):
        np.testing.assert_array_equal(dense(construct.eye(spark, 4, k), (4, 4)), np.eye(4, k=k))
    for args in ((0, 10, 3), (1, 2, 0.25), (5, 0, -2), (3, 3, 1)):
        assert [r["v"] for r in construct.arange(spark, *args).orderBy("i").collect()] == np.arange(*args).tolist()
    for n in (1, 2, 7):
        np.testing.assert_allclose([r["v"] for r in construct.linspace(spark, -1, 2, n).orderBy("i").collect()], np.linspace(-1, 2, n))
    assert construct.tabulate(spark, 0, 3, lambda i, j: i).isEmpty() and construct.tabulate(spark, 3, 0, lambda i, j: i).isEmpty()
    with pytest.raises(ValueError):
        construct.arange(spark, 0, 1, 0)
    x, y = construct.arange(spark, 0, 3), construct.arange(spark, 5, 7)
    gx, gy = np.meshgrid(np.arange(3), np.arange(5, 7))
    assert {(r["i"], r["j"]): (r["x"], r["y"]) for r in construct.meshgrid(x, y).collect()} == {(i, j): (gx[i, j], gy[i, j]) for i in range(2) for j in range(3)}
    np.testing.assert_array_equal(dense(construct.diag(y), (2, 2)), np.diag([5.0, 6.0]))


def test_slices(spark, a):
    m = cells(spark, a)
    np.testing.assert_array_equal(dense(matrix.pick(m, [4, 0, 0], [6, 1]), (3, 2)), a[[4, 0, 0]][:, [6, 1]])
    np.testing.assert_array_equal(dense(matrix.part(m, a.shape, (-3, None), (1, -2)), (3, 4)), a[-3:, 1:-2])
    got = matrix.split(m, [2, 5], 1)
    for k, want in enumerate(np.hsplit(a, [2, 5])):
        np.testing.assert_array_equal(dense(got.where(F.col("part") == k), want.shape), want)
    with pytest.raises(ValueError):
        matrix.split_evenly(m, 2, 5, 0)
    np.testing.assert_array_equal(dense(matrix.broadcast_to(cells(spark, a[:1]), (1, 7), (3, 7)), (3, 7)), np.broadcast_to(a[:1], (3, 7)))
    with pytest.raises(ValueError):
        matrix.broadcast_to(m, (5, 7), (5, 8))


@pytest.mark.parametrize("axis", [0, 1])
def test_axes(spark, a, axis):
    m = cells(spark, a)
    np.testing.assert_array_equal(dense(matrix.cumulative(m, axis), a.shape), a.cumsum(axis))
    np.testing.assert_array_equal(dense(matrix.cumulative(m, axis, "min"), a.shape), np.minimum.accumulate(a, axis))
    np.testing.assert_array_equal(dense(matrix.difference(m, axis), np.diff(a, axis=axis).shape), np.diff(a, axis=axis))
    np.testing.assert_array_equal(dense(matrix.ordered(m, axis), a.shape), np.sort(a, axis))
    want = pd.DataFrame(a).shift(-2, axis=axis, fill_value=9.0).to_numpy()
    np.testing.assert_array_equal(dense(matrix.shifted(m, -2, axis, 9.0), a.shape), want)
    with np.errstate(all="ignore"):
        moved = pd.DataFrame(a).shift(1, axis=axis).to_numpy()
        want = np.where((moved == 0) | np.isnan(moved), np.nan, (a - moved) / moved)
    np.testing.assert_allclose(dense(matrix.pct_change(m, axis), a.shape), want)
    vector = construct.arange(spark, 1, 1 + a.shape[axis])
    np.testing.assert_array_equal(dense(matrix.with_each(m, vector, axis, lambda v, w: v * w), a.shape), a * (np.arange(1, 8)[None] if axis == 1 else np.arange(1, 6)[:, None]))
    got = {r["i"]: r["v"] for r in matrix.along(m, axis, F.max("v") - F.min("v")).collect()}
    assert got == dict(enumerate(np.ptp(a, axis).tolist()))
    np.testing.assert_array_equal(dense(matrix.lanes(m, axis, lambda x: F.reverse(x)), a.shape), np.flip(a, axis))


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolution(spark, mode):
    x = np.arange(6.0) ** 2
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    for kernel in ([1.0, 2.0], [0.5, 0.25, 0.25], [1.0, -1.0, 3.0, 2.0]):
        got = [r["v"] for r in matrix.convolve(s, kernel, mode, 6).orderBy("i").collect()]
        np.testing.assert_allclose(got, np.convolve(x, kernel, mode))


def test_percentiles_of_crowded_values(spark):
    x = np.array([0.0] * 900 + list(range(1, 101)) + [math.nan] * 3)
    df = spark.createDataFrame([(float(v), float(-v)) for v in x[:1000]] + [(None, 0.0)], "x double, y double")
    ps = [0.0, 10.0, 89.95, 90.0, 95.5, 100.0]
    got = {(r["name"], r["p"]): r["value"] for r in ordered.percentiles_of(df, ["x", "y"], ps).collect()}
    for p in ps:
        assert got[("x", p)] == pytest.approx(np.percentile(x[:1000], p)) and got[("y", p)] == pytest.approx(np.percentile(np.append(-x[:1000], 0), p))
    assert ordered.percentiles(df.limit(0), "x", [50.0]).isEmpty()
    d = {r["name"]: r for r in reduce.describe(df, ["x", "y"]).collect()}
    assert d["x"]["p25"] == 0 and d["y"]["max"] == 0 and d["x"]["max"] == 100
    edges = [0.0, 1.0, 50.0, 100.0]
    assert [r["n"] for r in reduce.histogram_of(df, "x", edges).orderBy("bin").collect()] == np.histogram(x[:1000], edges)[0].tolist()
    with pytest.raises(ValueError):
        reduce.histogram_of(df, "x", [1.0, 1.0])


def test_large_means_and_nan_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = x @ [0.5, -0.2, 0.1] + rng.normal(size=200)
    rows = [(float(y[k]), *map(float, x[k])) for k in range(200)]
    names = ["y", "a", "b", "c"]
    small = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    large = spark.createDataFrame([tuple(v + 1e8 for v in row) for row in rows] + [(math.nan, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0)], ", ".join(f"{n} double" for n in names))
    for fit in (lambda d: regression.three_pass_filter(d, "y", names[1:], ["y"]), lambda d: regression.pls1(d, "y", names[1:])):
        one, two = fit(small), fit(large)
        assert two.n == one.n == 200 and two.r_squared == pytest.approx(one.r_squared, rel=1e-5)
        np.testing.assert_allclose(two.alpha, one.alpha, rtol=1e-5)


@pytest.mark.parametrize("procedure,window", [("recursive", 0), ("rolling", 0), ("cross", 0), ("cross", 3)])
def test_out_of_sample_by_refitting(spark, procedure, window):
    rng = np.random.default_rng(7)
    frames = []
    for key in ("p", "q"):
        x = rng.normal(size=(40, 3)) + 1000
        f = pd.DataFrame(x, columns=["a", "b", "c"])
        f.insert(0, "y", x @ [1.0, 0.5, -1.0] + rng.normal(size=40))
        f.insert(0, "t", range(40))
        f.insert(0, "k", key)
        frames.append(f)
    data = pd.concat(frames)
    data.iloc[5, 2] = np.nan
    df = spark.createDataFrame(data.sample(frac=1, random_state=1))
    got = {(r["k"], r["t"]): (r["forecast"], r["mean_forecast"]) for r in forecast.out_of_sample(df, "k", "t", "y", ["a", "b", "c"], procedure=procedure, train=12, window=window).collect()}
    assert len(got) == 80
    for f in frames:
        v = f[["y", "a", "b", "c"]].to_numpy()
        if f["k"].iloc[0] == "p":
            v[5, 0] = np.nan
        for t in range(40):
            at = np.arange(40)
            seen = {"recursive": at < t, "rolling": (at < t) & (at >= t - 12), "cross": np.abs(at - t) > window}[procedure] & ~np.isnan(v).any(1)
            forecasted, mean = got[(f["k"].iloc[0], t)]
            if seen.sum() < (12 if procedure != "cross" else 3):
                assert math.isnan(forecasted)
                continue
            m = forecast.Moments(5)
            for row in v[seen]:
                m.add(np.append(row, row[0]) - 1000)
            a, b = forecast.fit(m, 3)
            assert forecasted == pytest.approx(1000 + a + b @ (v[t, 1:] - 1000), rel=1e-6) and mean == pytest.approx(v[seen, 0].mean())


def test_paths(spark):
    rows = [(p, s, v) for p, path in {1: [10, 8, 9, 11, 5, 6, 12, 11], 2: [3, 3.5], 3: [7]}.items() for s, v in enumerate(path)]
    df = spark.createDataFrame([(p, s, float(v)) for p, s, v in rows], "p int, s int, x double").repartition(3)
    got = recurrences.ewma(df, "p", "s", "x", 0.5).orderBy("p", "s").collect()
    assert [r["ewma"] for r in got if r["p"] == 1][:3] == [10, 9, 9] and [r["ewma"] for r in got if r["p"] == 2] == [3, 3.25]
    assert [r["held"] for r in recurrences.banded(df, "p", "s", "x", 2.5).where("p = 1").orderBy("s").collect()] == [10, 10, 10, 10, 5, 5, 12, 12]
    late = {(r["p"], r["peak_at"]): r["depth"] for r in simulation.depth_at_exhaustion(df, "p", "s", "x", 2).collect()}
    assert late == {(1, 0): pytest.approx(0.1), (1, 3): pytest.approx(1 - 6 / 11), (1, 6): None}
    assert [r["vol"] for r in recurrences.volatility(df, "p", "s", "x").where("p = 3").collect()] == [0.0]
    none = df.limit(0)
    assert recurrences.ewma(none, "p", "s", "x", 0.5).isEmpty() and simulation.depth_at_exhaustion(none, "p", "s", "x", 2).isEmpty()


def test_draws_and_texts(spark):
    df = spark.range(20_000)
    row = df.select(random.normal(4, "id", mean=3.0, std=2.0).alias("x"), random.integers(4, 2, 7, "id").alias("k")).agg(F.avg("x"), F.stddev("x"), F.min("k"), F.max("k"), F.kurtosis("x")).first()
    assert abs(row[0] - 3) < 0.06 and abs(row[1] - 2) < 0.05 and (row[2], row[3]) == (2, 6) and abs(row[4]) < 0.2
    x = spark.createDataFrame([("1e21",), ("$1,234.5",), ("50%",), ("1e-19",), ("x",), (None,)], "x string")
    assert [r[0] for r in x.select(text.str2num("x", "double")).collect()] == [1e21, 1234.5, 0.5, 1e-19, None, None]
    n = spark.createDataFrame([(1234567.0,), (-0.001,), (0.256,), (None,)], "x double")
    assert [r[0] for r in n.select(text.formatted("x", "abbreviated")).collect()] == ["    1.23M", "     0.00", "     0.26", "      N/A"]
    assert [r[0] for r in n.select(text.formatted("x", "whole percent")).collect()][2] == "      26%" and [r[0] for r in n.select(text.signed("x", 1)).collect()][:2] == ["+1234567.0", "0.0"]
    assert [r[0] for r in spark.createDataFrame([("7",), ("e",), ("x",)], "c string").select(text.is_number_char("c")).collect()] == [True, True, False]
    bad = relational.bad_cells(spark.createDataFrame([(1.0, " "), (math.nan, "a"), (None, None)], "x double, s string"), ["x", "s"])
    assert {r["column"]: (r["n"], r["bad"]) for r in bad.collect()} == {"x": (3, 2), "s": (3, 2)}
    sums = spark.createDataFrame([("123456789",), ("",), (None,)], "x string").select(text.cksum("x").alias("c")).collect()
    assert [r["c"] for r in sums] == [930766865, 4294967295, None]


def test_ragged_rows_over_splits(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [[str(k), *("x" * int(rng.integers(0, 9)) + rng.choice(["", '""', "\n", ",", "\n\n"]) for _ in range(int(rng.integers(1, 4))))] for k in range(400)]
    rows[200][1] = "long\n" * 300
    p = tmp_path / "wide.csv"
    p.write_text("".join(",".join([r[0], *(f'"{x}"' for x in r[1:])]) + "\n" for r in rows))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        found = csv.read_ragged(spark, str(p))
        assert found.rdd.getNumPartitions() > 5
        got = [r["fields"] for r in found.orderBy("rid").collect()]
        table = csv.read_smart(spark, str(p))
        assert table.count() == 400 and len(table.columns) == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [[r[0], *(x.replace('""', '"') for x in r[1:])] for r in rows]
    q = tmp_path / "latin.csv"
    q.write_bytes("a,é\n1,ü\n".encode("latin-1"))
    assert [r["fields"] for r in csv.read_ragged(spark, str(q), ",").orderBy("rid").collect()] == [["a", "é"], ["1", "ü"]]
