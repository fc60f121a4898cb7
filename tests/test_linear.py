"""Tall and blocked matrices against NumPy."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from millrace.operators import blocks, tall
from millrace.plans import series


def tall_table(spark, x):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "rid long, " + ", ".join(f"x{k} double" for k in range(x.shape[1])))
    return df.repartition(20, "rid"), [f"x{k}" for k in range(x.shape[1])]


def matrix_of(df, keep, names):
    return np.array([[r[n] for n in names] for r in df.orderBy(keep).collect()])


def ill_conditioned(rng, n, k, condition):
    u, v = np.linalg.qr(rng.standard_normal((n, k)))[0], np.linalg.qr(rng.standard_normal((k, k)))[0]
    return u * np.geomspace(1, 1 / condition, k) @ v.T


def test_tall_qr_and_svd(spark):
    rng = np.random.default_rng(1)
    for x in (rng.standard_normal((300, 5)) + 100, ill_conditioned(rng, 400, 8, 1e9), rng.standard_normal((6, 6))):
        df, names = tall_table(spark, x)
        df = df.withColumn("q0", df["x0"])  # the name of an inner column
        q, r = tall.qr(df, names, ["rid"])
        want = np.linalg.qr(x)[1]
        want *= np.sign(np.diag(want))[:, None]
        got = matrix_of(q, "rid", names)
        np.testing.assert_allclose(r, want, atol=1e-9 * np.abs(want).max())
        np.testing.assert_allclose(got.T @ got, np.eye(x.shape[1]), atol=1e-12)
        np.testing.assert_allclose(got @ r, x, atol=1e-11 * np.abs(x).max())
        s = np.linalg.svd(x, compute_uv=False)
        np.testing.assert_allclose([v["value"] for v in tall.singular_values(df, names).orderBy("k").collect()], s, rtol=1e-6, atol=1e-14 * s[0])
        u, s3, vt = tall.svd(df, names, ["rid"], 3)
        u = matrix_of(u, "rid", ["u0", "u1", "u2"])
        np.testing.assert_allclose(u.T @ u, np.eye(3), atol=1e-9)
        np.testing.assert_allclose(x @ vt.T, u * s3, atol=1e-9 * s[0])
    # the Gram matrix has lost the small values at this condition
    assert abs(s[0] / s[-1]) > 1 and tall.SMALL >= 512


def test_tall_edges(spark):
    df, names = tall_table(spark, np.array([[1.0, 2.0, 3.0], [2.0, 4.0, 1.0]]))  # fewer rows than columns
    want = np.linalg.svd(np.array([[1.0, 2.0, 3.0], [2.0, 4.0, 1.0]]), compute_uv=False)
    np.testing.assert_allclose([v["value"] for v in tall.singular_values(df, names).orderBy("k").collect()], [*want, 0], atol=1e-12)
    with pytest.raises(ValueError):
        tall.qr(df, names, ["rid"])
    assert not tall.r_factor(df.limit(0), names).any() and tall.moments(df.limit(0), names)[0] == 0
    assert np.isnan(tall.r_factor(df.selectExpr("rid", "IF(rid = 0, NULL, x0) AS x0", "x1"), ["x0", "x1"])[0, 0])
    with pytest.raises(ValueError):
        tall.r_factor(df, [])


def test_tall_tree(spark, monkeypatch):
    monkeypatch.setattr(tall, "FAN", 3)
    x = np.random.default_rng(2).standard_normal((200, 4)) * [1, 10, 100, 1000] + 1e6
    df, names = tall_table(spark, x)
    want = np.linalg.qr(x)[1]
    np.testing.assert_allclose(np.abs(tall.r_factor(df, names)), np.abs(want), rtol=1e-7, atol=1e-6)
    n, mean, c = tall.moments(df, names)
    assert n == 200
    np.testing.assert_allclose(mean, x.mean(0))
    np.testing.assert_allclose(c / 199, np.cov(x.T), rtol=1e-9, atol=1e-9)


def test_tall_least_squares(spark):
    rng = np.random.default_rng(3)
    x = ill_conditioned(rng, 300, 6, 1e9)
    y = x @ np.arange(1.0, 7.0) + 2 + 1e-12 * rng.standard_normal(300)
    df, names = tall_table(spark, np.column_stack([x, y, x[:, 0] * 2]))
    fit = tall.least_squares(df, "x6", names[:6], intercept=True)
    np.testing.assert_allclose(fit.coefficients, [1, 2, 3, 4, 5, 6, 2], rtol=1e-2)  # the error is the condition times the noise
    assert fit.rank == 7 and fit.residual < 1e-20
    dependent = tall.least_squares(df, "x6", ["x0", "x7"])
    want = np.linalg.lstsq(np.column_stack([x[:, 0], 2 * x[:, 0]]), y, rcond=1e-10)
    np.testing.assert_allclose(dependent.coefficients, want[0])
    assert dependent.rank == 1 and dependent.residual == pytest.approx(np.sum((np.column_stack([x[:, 0], 2 * x[:, 0]]) @ want[0] - y) ** 2))


def test_wide_tables_are_quick(spark):
    x = np.random.default_rng(4).standard_normal((50, 512))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").selectExpr(*[f"v[{k}] AS x{k}" for k in range(512)])
    got = tall.r_factor(df, [f"x{k}" for k in range(512)])
    np.testing.assert_allclose(got.T @ got, x.T @ x, atol=1e-9)


def blocked(spark, x, size):
    cells = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if v], "i long, j long, v double")
    return blocks.from_cells(cells, *x.shape, size)


def dense(m):
    out = np.zeros((m.rows, m.columns))
    for r in blocks.cells(m).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_blocked_products(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((23, 37)), rng.standard_normal((37, 11))
    a[:8, :8] = 0  # a block that is not there
    for depth in (64, 2):
        monkeypatch.setattr(blocks, "DEPTH", depth)
        np.testing.assert_allclose(dense(blocks.matmul(blocked(spark, a, 8), blocked(spark, b, 8))), a @ b, atol=1e-12)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "i long, v array<double>")
    m = blocks.from_rows(rows, "i", "v", 23, 37, 8)
    np.testing.assert_allclose(dense(m), a)
    np.testing.assert_allclose(dense(blocks.matmul(m, blocks.transposed(m))), a @ a.T, atol=1e-12)
    np.testing.assert_allclose(dense(blocks.plus(m, m, -2.0)), -a)
    np.testing.assert_allclose(dense(blocks.identity(spark, 11, 4)), np.eye(11))
    with pytest.raises(ValueError):
        blocks.matmul(m, m)


def test_elimination(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((21, 21)), rng.standard_normal((21, 3))
    a[0, 0] = 0.0
    a[:5, :5] = 0.0  # no pivot in the first block
    m, right = blocked(spark, a, 8), blocked(spark, b, 8)
    x, sign, log = blocks.eliminate(m, right)
    np.testing.assert_allclose(dense(x), np.linalg.solve(a, b), atol=1e-10)
    assert (sign, log) == pytest.approx(np.linalg.slogdet(a))
    assert blocks.determinant(m) == pytest.approx(np.linalg.slogdet(a))
    np.testing.assert_allclose(dense(blocks.inverse(m)), np.linalg.inv(a), atol=1e-10)
    flat = np.zeros((9, 9))
    flat[:, :4] = rng.standard_normal((9, 4))
    assert blocks.determinant(blocked(spark, flat, 4))[0] == 0
    with pytest.raises(np.linalg.LinAlgError):
        blocks.solve(blocked(spark, flat, 4), blocked(spark, b[:9], 4))


def test_cholesky(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((19, 30))
    a = x @ x.T + np.eye(19)
    low = dense(blocks.cholesky(blocked(spark, a, 8)))
    np.testing.assert_allclose(low, np.linalg.cholesky(a), atol=1e-10)
    with pytest.raises(np.linalg.LinAlgError):
        blocks.cholesky(blocked(spark, -a, 8))


def test_leading_pairs(spark):
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = np.concatenate([[9, -7, 5, 4], np.linspace(0.5, 0.01, 36)])
    a = q * values @ q.T
    got, vectors = blocks.eigh(blocked(spark, (a + a.T) / 2, 16), 4, more=4)
    v = dense(vectors)
    np.testing.assert_allclose(got, [9, -7, 5, 4], atol=1e-8)
    np.testing.assert_allclose(a @ v, v * got, atol=1e-8)


@pytest.mark.parametrize("panel", [4, 8])
def test_elimination_in_tasks(spark, monkeypatch, panel):
    """Tiles of more than one block and joined blocks; the driver, whose BLAS threads can stall after a fork, factors nothing."""
    monkeypatch.setattr(blocks, "PANEL", panel)
    monkeypatch.setattr(blocks, "FAN", 3)
    monkeypatch.setattr(blocks, "SPREAD", 2)
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((23, 23)), rng.standard_normal((23, 3))
    a[:8, :8], a[8:16, 16:20] = 0.0, 0.0  # blocks that are not there
    want, determinant = np.linalg.solve(a, b), np.linalg.slogdet(a)
    m, right = blocks.kept(blocked(spark, a, 4)), blocks.kept(blocked(spark, b, 4))
    for name in ("inv", "slogdet", "cholesky", "solve"):
        monkeypatch.setattr(np.linalg, name, None)
    x, sign, log = blocks.eliminate(m, right)
    np.testing.assert_allclose(dense(x), want, atol=1e-9)
    assert (sign, log) == pytest.approx(tuple(determinant))


def test_updated_identity(spark):
    """I + u v' is solved for without its square; a large update cancels and is refined."""
    rng = np.random.default_rng(10)
    u, v, b = rng.standard_normal((23, 5)), rng.standard_normal((23, 5)), rng.standard_normal((23, 3))
    for by in (1.0, 1e4):
        m, n, right = (blocked(spark, x, 4) for x in (by * u, v, b))
        x = blocks.solve_updated(m, n, right)
        want = np.linalg.solve(np.eye(23) + by * u @ v.T, b)
        np.testing.assert_allclose(dense(x), want, atol=1e-9)
        np.testing.assert_allclose(dense(blocks.updated(m, n, x)), b, atol=1e-11 * by)
    one = np.zeros((9, 1))
    one[4] = 1.0
    with pytest.raises(np.linalg.LinAlgError):
        blocks.solve_updated(blocked(spark, one, 4), blocked(spark, -one, 4), blocked(spark, b[:9], 4))
    with pytest.raises(ValueError):
        blocks.solve_updated(m, right, right)


def test_blocked_solve_has_no_square(spark, tmp_path, monkeypatch):
    """No system and no product of the query has as many columns as there are rows; a tie at the last digit stays one."""
    rng, shapes = np.random.default_rng(11), []
    x = rng.standard_normal((300, 64)).astype("float32") / 8
    x[7, 3], x[8, 4] = 9 / 128, -9 / 128  # 0.0703125
    spark.createDataFrame([(7 * i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    multiply = blocks.matmul
    monkeypatch.setattr(blocks, "matmul", lambda a, b: shapes.append((a.rows, b.columns)) or multiply(a, b))
    monkeypatch.setattr(blocks, "MOST", 64)
    got = {(r["i"], r["j"]): r["v"] for r in series.blocked_solve(spark, str(tmp_path)).collect()}
    assert shapes and max(map(min, shapes)) <= 64
    assert got == {(i, j): float(Decimal(float(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for (i, j), v in np.ndenumerate(x)}
