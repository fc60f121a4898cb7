"""Recurrences along paths in chunks of any size against plain loops."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import recurrences


def loop(values, step):
    state, out = None, []
    for x in values:
        state, y = step(state, x)
        out.append(y)
    return out


def average(mean, x, keep=0.9):
    mean = x if mean is None else mean if x is None else keep * mean + (1 - keep) * x
    return mean, mean


def held(h, x, band=1.5):
    h = x if h is None or (x is not None and abs(x - h) > band) else h
    return h, h


def vol(state, x):
    if state is None:
        return (x, 1e-4), 0.0
    before, square = state
    change = math.log(x / before) if x and before and x / before > 0 else 0.0
    square = 0.94 * square + 0.06 * change * change
    return (x, square), math.sqrt(square * 252)


def median_of(values):
    seen, out = [], []
    for x in values:
        seen += [] if x is None else [x]
        out.append(statistics.median(seen) if seen else None)
    return out


@pytest.fixture(scope="module")
def paths():
    """A path with most rows, short ones, empty stretches, one value only, and ties."""
    rng = np.random.default_rng(3)
    long = [None if rng.random() < 0.1 else float(v) for v in np.cumsum(rng.standard_normal(700))]
    long[:3], long[200:290] = [None] * 3, [None] * 90
    return {
        1: long, 2: [5.0], 3: [None, None], 4: [float(v) for v in rng.integers(0, 3, 150)], 5: [7.0] * 120,
        None: [1.0, 4.0, 2.0], 6: [float(v) for v in np.linspace(0, 30, 90)], 7: [-1.0, 0.0, 2.0, None, 3.0],
    }


def frame(spark, paths):
    rows = [(p, 10 * k + 1, v, "clash") for p, values in paths.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "p long, s long, x double, chunk string").repartition(5, "s")


@pytest.mark.parametrize("size", [3, 40, 100_000])
def test_recurrences_like_loops(spark, paths, size):
    df = frame(spark, paths)
    for made, name, step in ((recurrences.ewma(df, "p", "s", "x", 0.9, size), "ewma", average), (recurrences.banded(df, "p", "s", "x", 1.5, size), "held", held), (recurrences.volatility(df, "p", "s", "x", size=size), "vol", vol)):
        got = {}
        for r in made.orderBy("p", "s").collect():
            got.setdefault(r["p"], []).append(r[name])
        assert set(got) == set(paths)
        for p, values in paths.items():
            want = loop(values, step)
            assert [x is None for x in got[p]] == [x is None for x in want], (name, p)
            np.testing.assert_allclose([x for x in got[p] if x is not None], [x for x in want if x is not None], rtol=1e-9, atol=1e-12, err_msg=f"{name} {p}")


@pytest.mark.parametrize("size", [4, 60, 100_000])
def test_expanding_median_like_a_loop(spark, paths, size):
    got = {}
    for r in recurrences.expanding_median(frame(spark, paths), "p", "s", "x", size=size).orderBy("p", "s").collect():
        got.setdefault(r["p"], []).append(r["median"])
    assert got == {p: median_of(values) for p, values in paths.items()}


def test_maps_of_a_held_value():
    """A chunk's map gives the end of its walk from every state before it."""
    rng = np.random.default_rng(4)
    for _ in range(100):
        band = float(rng.choice([0.5, 1, 3]))
        rule, x = recurrences._band(band), rng.integers(0, 12, rng.integers(1, 25)) / 2
        for state in [None, *np.arange(-3, 10, 0.25)]:
            want = rule.run(None if state is None else float(state), x)[-1]
            assert rule.after(None if state is None else float(state), rule.summary(x)) == want


def test_long_walks_don_t_underflow(spark):
    df = spark.range(30_000).select(F.lit(1).alias("p"), F.col("id").alias("s"), (F.col("id") % 7).cast("double").alias("x"))
    got = [r["ewma"] for r in recurrences.ewma(df, "p", "s", "x", 0.5, 5000).orderBy("s").collect()]
    np.testing.assert_allclose(got, loop([float(k % 7) for k in range(30_000)], lambda m, x: average(m, x, 0.5)))


def test_chunks(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("p"), F.col("id").alias("s"))
    cut = recurrences.chunked(df, "p", "s", "chunk", 100, 10)
    sizes = {(r["p"], r["chunk"]): r["count"] for r in cut.groupBy("p", "chunk").count().collect()}
    assert sum(sizes.values()) == 1000 and max(sizes.values()) <= 220 and all(c == 0 for p, c in sizes if p != 1) and len([1 for p, _ in sizes if p == 1]) >= 6
    days = spark.sql("SELECT DATE'2020-01-01' AS d, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS t UNION ALL SELECT NULL, NULL UNION ALL SELECT DATE'2021-01-01', TIMESTAMP_NTZ'2021-01-01 00:00:00'")
    assert {r["k"] for r in recurrences.bucketed(days, "d", "k", 2).collect()} == {r["k"] for r in recurrences.bucketed(days, "t", "k", 2).collect()} == {0, 1}
    none = spark.createDataFrame([], "p long, s long, x double")
    assert recurrences.ewma(none, "p", "s", "x", 0.5).isEmpty() and recurrences.expanding_median(none, "p", "s", "x").isEmpty()
