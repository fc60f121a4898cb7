"""Values that the functions and operators must give on small literal tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, decimal, ieee, text
from millrace.operators import forecast, matrix, ordered, random, recurrences, reduce, regression, relational, simulation
from millrace.sources import csv, tables

NAN, INF = float("nan"), float("inf")


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and w is None) or (isinstance(w, float) and math.isnan(w) and math.isnan(g)) or g == pytest.approx(w) if isinstance(w, float) else g == w


def test_ieee(spark):
    v = [1.0, NAN, -2.5, 0.0, INF]
    same(column(spark, v, ieee.gt("x", 0.5)), [True, False, False, False, True])
    same(column(spark, v, ieee.ne("x", 1.0)), [False, True, True, True, True])
    same(column(spark, v, ieee.divide("x", 0.0)), [INF, NAN, -INF, NAN, INF])
    same(column(spark, v, ieee.ln("x")), [0.0, NAN, NAN, -INF, INF])
    same(column(spark, v, ieee.round_half_up("x")), [1.0, 0.0, -2.0, 0.0, INF])
    same(column(spark, v, ieee.nan_to_num("x")), [1.0, 0.0, -2.5, 0.0, 0.0])
    same(column(spark, v, ieee.clip("x", -1.0, 2.0)), [1.0, NAN, -1.0, 0.0, 2.0])
    same(column(spark, v, ieee.sign("x")), [1.0, 0.0, -1.0, 0.0, 1.0])
    same(column(spark, v, ieee.trunc("x")), [1.0, NAN, -2.0, 0.0, INF])
    same(column(spark, [-800.0, 0.0, 800.0], ieee.sigmoid("x")), [0.0, 0.5, 1.0])
    same(column(spark, v, ieee.between("x", 0.0, NAN)), [True, True, False, True, True])


def test_text(spark):
    v = ["$1,234.50", "12.5%", "abc", "5%5", ".5", "", None, "-3", "1e3"]
    got = column(spark, v, text.str2num("x").cast("double"), "string")
    assert got == [1234.5, 0.125, None, None, 0.5, None, None, -3.0, 1000.0]
    assert column(spark, [0.0, -0.001, 1234567.0, NAN, None], text.num_str("x", 2, True)) == ["0.00", "0.00", "1.23M", "N/A", "N/A"]
    assert column(spark, ["a/b.txt", ".rc", "C:\\x\\y.tar.gz", "p/"], text.base_name("x"), "string") == ["b", "", "y.tar", "p"]
    assert column(spark, ["a/b.txt", ".rc", "p"], text.extension("x"), "string") == ["txt", "rc", ""]
    assert column(spark, ["", "123456789", None], text.cksum("x"), "string") == [4294967295, 930766865, None]
    assert column(spark, ["(1,234)", "2024-01-05", "5K", "word"], text.specific_type("x"), "string") == ["Big", "DateTime", "Big", "String"]


def test_dates(spark):
    v = ["2024-02-29", "2/29/2023", "Feb 3, 2021 4:05 pm", "31.12.99", "3 March 2020", "20240105", "nonsense", "2024-01-05T10:20:30", None]
    got = [str(x) if x else None for x in column(spark, v, dates.parse("x"), "string")]
    assert got == ["2024-02-29 00:00:00", None, "2021-02-03 16:05:00", "1999-12-31 00:00:00", "2020-03-03 00:00:00", "2024-01-05 00:00:00", None, "2024-01-05 10:20:30", None]
    df = lambda x: spark.createDataFrame([(i,) for i in x], "s string")
    assert [dates.infer_order(df(x), "s").first()[0] for x in (["13/1/2020"], ["1/13/2020"], ["1/2/2020"], ["13/1/2020", "1/13/2020"])] == ["DayFirst", "MonthFirst", "Auto", "None"]


def test_group_by_and_merge(spark):
    t = spark.createDataFrame([(0, 2.0, 10.0, 1.0), (1, 1.0, 20.0, 2.0), (2, 2.0, 30.0, 3.0), (3, 1.0, 40.0, NAN)], "rid long, sector double, price double, vol double")
    got = relational.group_by(t, "sector", "mean", "rid").orderBy("first_seen").select("sector", "price", "vol").collect()
    assert [tuple(r)[:2] for r in got] == [(2.0, 20.0), (1.0, 30.0)] and got[0][2] == 2.0 and math.isnan(got[1][2])
    assert relational.group_by(t, "sector", {"vol": "sum", "price": "max"}).columns == ["sector", "price_max", "vol_sum"]
    with pytest.raises(KeyError):
        relational.group_by(t, "nowhere", "mean")
    with pytest.raises(ValueError):
        relational.group_by(t, "sector", {"nothing": "sum"})
    a = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (NAN, 5.0)], "id double, p double")
    b = spark.createDataFrame([(2.0, 200.0, 2.5), (4.0, 400.0, 4.5), (2.0, 201.0, 2.6), (NAN, 7.0, 7.0)], "id double, p double, q double")
    assert relational.merge(a, b, "id").columns == ["id", "p_x", "p_y", "q"]
    assert [relational.merge(a, b, "id", h).count() for h in ("inner", "left", "right")] == [2, 4, 4]


def test_sort_key(spark):
    df = spark.createDataFrame([("10", "b"), ("9", "a"), ("x", "c"), ("9", "z")], "k string, v string")
    assert [tuple(r) for r in df.orderBy(*relational.sort_key(df, "0,-1")).collect()] == [("9", "z"), ("9", "a"), ("10", "b"), ("x", "c")]


def test_ordered_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=200)
    x[17] = NAN
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").repartition(5)
    col = lambda d, c: np.array([r[c] for r in d.orderBy("i").collect()])
    y = np.nan_to_num(x)
    dg = df.withColumn("x", ieee.fill_nan("x", 0.0))
    np.testing.assert_allclose(col(ordered.running(dg, "i", "x", "sum", "s"), "s"), np.cumsum(y))
    np.testing.assert_allclose(col(ordered.running(dg, "i", "x", "max", "s"), "s"), np.maximum.accumulate(y))
    want = np.full(200, NAN)
    want[6:] = np.lib.stride_tricks.sliding_window_view(y, 7).std(1)
    np.testing.assert_allclose(col(ordered.rolling(dg, "i", "x", 7, "std", "s", rows=16), "s"), want, atol=1e-12)
    np.testing.assert_allclose(col(ordered.shift(dg, "i", "x", 3, -1.0, "s", rows=16), "s"), np.append([-1.0] * 3, y[:-3]))
    np.testing.assert_allclose(col(ordered.shift(dg, "i", "x", -2, 0.0, "s"), "s"), np.append(y[2:], [0.0, 0.0]))
    got = {r["p"]: r["value"] for r in ordered.percentiles(dg, "x", [0.0, 33.0, 50.0, 100.0]).collect()}
    assert all(got[p] == pytest.approx(np.percentile(y, p)) for p in got)
    assert [r["i"] for r in ordered.dense_index(dg.select("x"), "x").orderBy("i").collect()] == list(range(200))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 9.99, 10.0, 11.0)], "x double")
    assert [r["n"] for r in reduce.histogram(df, "x", 5, 0.0, 10.0).orderBy("bin").collect()] == [3, 0, 0, 0, 2]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["n"] for r in reduce.histogram(flat, "x", 2).orderBy("bin").collect()] == [2, 0]


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_matrix_against_numpy(spark):
    g = np.random.default_rng(2)
    a, b = g.normal(size=(4, 3)), g.normal(size=(3, 5))
    ca, cb = cells(spark, a), cells(spark, b)
    np.testing.assert_allclose(dense(matrix.matmul(ca, cb), (4, 5)), a @ b)
    np.testing.assert_allclose(dense(matrix.kron(ca, cb, (3, 5)), (12, 15)), np.kron(a, b))
    np.testing.assert_allclose(dense(matrix.tile(ca, (4, 3), 2, 3), (8, 9)), np.tile(a, (2, 3)))
    np.testing.assert_allclose(dense(matrix.repeat_rows(ca, 2), (8, 3)), np.repeat(a, 2, axis=0))
    np.testing.assert_allclose(dense(matrix.reshape(ca, 3, 6), (2, 6)), a.reshape(2, 6))
    np.testing.assert_allclose(dense(matrix.tril(ca, -1), (4, 3)), np.tril(a, -1))
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a.ravel())], "i long, v double")
    got = {r["i"]: r["v"] for r in matrix.correlate(s, [1.0, -2.0, 0.5], 12).collect()}
    np.testing.assert_allclose([got[i] for i in sorted(got)], np.correlate(a.ravel(), [1.0, -2.0, 0.5], "valid"))
    vectors = spark.createDataFrame([(list(map(float, a.ravel())),)], "r array<double>").select(matrix.softmax(F.col("r")).alias("s"), matrix.log_softmax(F.col("r")).alias("l"), matrix.argsort(F.col("r")).alias("o")).first()
    np.testing.assert_allclose(vectors["s"], np.exp(a.ravel()) / np.exp(a).sum())
    np.testing.assert_allclose(vectors["l"], np.log(vectors["s"]))
    assert vectors["o"] == np.argsort(a.ravel(), kind="stable").tolist()


def test_regressions_against_numpy(spark):
    g = np.random.default_rng(3)
    x, z = g.normal(size=(60, 4)) * [1, 5, 0.1, 2], g.normal(size=(60, 2))
    y = x @ [1.0, -2.0, 3.0, 0.5] + 7 + g.normal(size=60) * 0.1
    names = ["y", *[f"x{k}" for k in range(4)], "z0", "z1"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([y, x, z])], ", ".join(f"{n} double" for n in names))
    fit = regression.lm(df.unionByName(df.limit(1).withColumn("x0", F.lit(NAN))), "y", names[1:5])
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    np.testing.assert_allclose([fit.intercept, *fit.coefficients], want)
    np.testing.assert_allclose(regression.polyfit(df, "x1", "y", 2), np.polyfit(x[:, 1], y, 2))
    # The three passes, one by one.
    s = x / x.std(0, ddof=1)
    one = np.ones((60, 1))
    phi = np.linalg.lstsq(np.hstack([one, z]), s, rcond=None)[0][1:].T
    sigma = np.linalg.lstsq(np.hstack([np.ones((4, 1)), phi]), s.T, rcond=None)[0][1:].T
    fitted = np.hstack([one, sigma]) @ np.linalg.lstsq(np.hstack([one, sigma]), y, rcond=None)[0]
    f = regression.three_pass_filter(df, "y", names[1:5], ["z0", "z1"])
    np.testing.assert_allclose(f.intercept + x @ f.alpha, fitted, rtol=1e-6)


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a;b\r\n"x;1";2\r\r\n ; \n"say ""hi""";"u"v"\nlast')
    assert csv.detect_delimiter(p.read_text()) == ";"
    rows = [r["fields"] for r in csv.read_ragged(spark, str(p)).orderBy("rid").collect()]
    assert rows == [["a", "b"], ["x;1", "2"], ['say "hi"', 'u"v'], ["last"]]
    assert {len(r["fields"]) for r in csv.rectangular(csv.read_ragged(spark, str(p))).collect()} == {2}
    q = tmp_path / "b.csv"
    q.write_text("Price,,Price\n1,2%,x\n$3,4,5\n")
    df = csv.read_smart(spark, str(q))
    assert df.columns == ["Price", "col2", "Price_2"]
    got = [tuple(r) for r in df.collect()]
    assert got[0][:2] == (1.0, 0.02) and math.isnan(got[0][2]) and got[1] == (3.0, 4.0, 5.0)
    csv.write_matrix(df, str(tmp_path / "out"), df.columns)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1.0,0.02,NaN", "3.0,4.0,5.0"]


def test_width_of_all_rows(spark, tmp_path):
    p = tmp_path / "late.csv"
    p.write_text("1,2,3\n" * 150 + "4,5,6,7,8\n")
    df = csv.read_smart(spark, str(p))
    assert csv.width_of(spark, str(p), ",") == 5
    assert len(df.columns) == 5 and [tuple(r) for r in df.where("col1 = 4").collect()] == [(4.0, 5.0, 6.0, 7.0, 8.0)] and df.count() == 151
    q = tmp_path / "held.csv"
    q.write_text("1,2,3\n" * 150 + '4,"x\ny",6,7\n')
    df = csv.read_smart(spark, str(q))
    assert csv.width_of(spark, str(q), ",") == 4
    assert len(df.columns) == 4 and df.count() == 151 and df.where("col4 = 7").count() == 1


def test_simulation(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([10, 8, 9, 11, 5, 6])], "p int, s int, x double")
    got = simulation.episodes(df, "p", "s", "x", 10).orderBy("start").collect()
    assert [(r["start"], r["end"], round(r["depth"], 4), r["recovered"]) for r in got] == [(1, 2, 0.2, True), (4, 5, 0.5455, False)]
    assert [r["held"] for r in recurrences.banded(df, "p", "s", "x", 2.5).orderBy("s").collect()] == [10, 10, 10, 10, 5, 5]


def test_draws(spark):
    df = spark.range(4000).select("id", F.lit(1.0).alias("x"))
    a, b = random.dropout(df, ["x"], 0.25, 1, "id"), random.dropout(df.repartition(7), ["x"], 0.25, 1, "id")
    assert a.exceptAll(b).isEmpty() and 2850 < a.where("x > 0").count() < 3150


def test_decimal_scales(spark):
    import decimal as d

    values = ["2.5", "-2.5", "3.45", "-3.45", "1.05", "-0.04", "7", None]
    for mode in ("HALF_EVEN", "HALF_UP", "HALF_DOWN", "UP", "DOWN", "CEILING", "FLOOR"):
        for scale in (0, 1):
            df = spark.createDataFrame([(i, v and d.Decimal(v)) for i, v in enumerate(values)], "i int, x decimal(18,4)")
            got = [r[0] for r in df.orderBy("i").select(decimal.set_scale("x", scale, mode)).collect()]
            assert got == [v and d.Decimal(v).quantize(d.Decimal(1).scaleb(-scale), getattr(d, f"ROUND_{mode}")) for v in values], (mode, scale)
    row = spark.createDataFrame([(d.Decimal("3.00"),)], "x decimal(9,2)").select(decimal.divide("x", F.lit(0)).alias("a"), decimal.power("x", 3).alias("b"), decimal.power("x", -1).alias("c"), decimal.sqrt(-F.col("x")).alias("e")).first()
    assert row["a"] is None and row["b"] == 27 and row["c"] is None and row["e"] is None


def refit(y, x, z):
    """Intercept and weights of the three-pass filter from whole arrays."""
    d = x.std(0, ddof=1)
    s = (x - x.mean(0)) / d
    w = s.T @ (z - z.mean(0))
    w = w - w.mean(0)
    f = s @ w
    alpha = w @ np.linalg.lstsq(f.T @ f, f.T @ (y - y.mean()), rcond=1e-12)[0] / d
    return float(y.mean() - alpha @ x.mean(0)), alpha


def test_forecasts_against_a_loop(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(2, 30, 3))
    y = x @ [1.0, -1.0, 0.5] + g.normal(size=(2, 30)) * 0.2
    rows = [(k, t, float(y[k, t]), *map(float, x[k, t])) for k in range(2) for t in range(30)]
    df = spark.createDataFrame(rows, "k int, t int, y double, a double, b double, c double")
    for procedure, seen in (("recursive", lambda t, s: s < t), ("rolling", lambda t, s: t - 12 <= s < t), ("cross", lambda t, s: s != t)):
        got = {(r["k"], r["t"]): r["forecast"] for r in forecast.out_of_sample(df, "k", "t", "y", ["a", "b", "c"], procedure=procedure, train=12).collect()}
        cut = {(r["k"], r["t"]): r["forecast"] for r in forecast.out_of_sample(df, "k", "t", "y", ["a", "b", "c"], procedure=procedure, train=12, size=7).collect()}
        assert set(cut) == set(got) and all(cut[x] == pytest.approx(got[x], nan_ok=True) for x in got)
        for k, t in ((0, 12), (1, 29), (1, 20)):
            at = [s for s in range(30) if seen(t, s)]
            a, b = refit(y[k, at], x[k, at], y[k, at][:, None])
            assert got[k, t] == pytest.approx(a + b @ x[k, t])
        assert procedure == "cross" or math.isnan(got[0, 3])


def test_hash64(spark):
    pattern = lambda n: bytes(i % 251 for i in range(n))
    want = {0: "ef46db3751d8e999", 1: "e934a84adb052768", 31: "1c6261c72c5bb941", 32: "5eb185272875c70a", 33: "de3c11f38ec8382d", 55: "064bcac1af2898bb", 56: "303d0e17bdea8ee3", 57: "c55313ac7231cc51"}
    got = text.hashes64([pattern(n) for n in want])
    assert [f"{h:016x}" for h in got.tolist()] == list(want.values())
    values = [pattern(n) for n in (500, 63, 64, 65, 127, 128, 129, 1000, 0, 64)]
    assert text.hashes64(values).tolist() == [int(text.hashes64([v])[0]) for v in values]  # one by one as side by side
    df = spark.createDataFrame([("", b"a"), (None, None), ("\x00", b"\x00")], "s string, b binary")
    assert [tuple(r) for r in df.select(text.hash64("s"), text.hash64("b")).collect()] == [("ef46db3751d8e999", f"{int(text.hashes64([b'a'])[0]):016x}"), (None, None), ("e934a84adb052768",) * 2]


def test_autocorrelations(spark):
    x = np.random.default_rng(5).standard_normal(500) + 1000
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double").repartition(5)
    for how, y in (("plain", x), ("square", x * x)):
        for rows in (30, 100_000):
            got = [r["autocorr"] for r in ordered.autocorrelations(df, "i", "v", 25, how, rows).orderBy("lag").collect()]
            np.testing.assert_allclose(got, [np.corrcoef(y[k:], y[:-k])[0, 1] for k in range(1, 26)], atol=1e-7)
    assert [r["autocorr"] for r in ordered.autocorrelations(df.where("i < 3"), "i", "v", 3).orderBy("lag").collect()][1:] == [None, None]
    assert all(r["autocorr"] is None for r in ordered.autocorrelations(df.limit(0), "i", "v", 2).collect())


def test_contents_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é\nb")
    (tmp_path / "b.bin").write_bytes(b"\xff\x00")
    (tmp_path / "c.txt").write_text("too long")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["content"] and bytes(r["content"]), r["text"]) for r in tables.contents(spark, str(tmp_path), 5).collect()}
    assert got == {"a.txt": (4, "é\nb".encode(), "é\nb"), "b.bin": (2, b"\xff\x00", None), "c.txt": (8, None, None)}
    df = spark.createDataFrame([("ABC",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(text.lookup_ignoring_case("s", {"abc": "1", "Abc": "2"})).collect()] == ["2", None, None]
    assert [r[0] for r in df.select(text.lookup_ignoring_case("s", {})).collect()] == [None] * 3
    assert tuple(matrix.shape(spark.createDataFrame([], "i long, j long, v double")).first()) == (0, 0, 0, 0)
