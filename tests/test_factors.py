"""The three-pass filter against three passes of regressions over whole arrays."""

import numpy as np
import pytest

from millrace.operators import factors, regression


def three_passes(y, x, z):
    """Loadings, factors and fit, regression by regression."""
    x = x / x.std(0, ddof=1)
    one = lambda m: np.column_stack([np.ones(len(m)), m])
    phi = np.linalg.lstsq(one(z), x, rcond=None)[0][1:].T
    sigma = np.stack([np.linalg.lstsq(one(phi), row, rcond=None)[0][1:] for row in x])
    beta = np.linalg.lstsq(one(sigma), y, rcond=None)[0]
    return phi, sigma, beta, one(sigma) @ beta


def variance(y, x, z, fitted):
    """The asymptotic variance of the weights, with dense centring matrices."""
    x = x / x.std(0, ddof=1)
    t, n = x.shape
    jt, jn = np.eye(t) - 1 / t, np.eye(n) - 1 / n
    a, b, c = x.T @ jt @ z / t, z.T @ jt @ x @ jn @ x.T @ jt @ x @ jn @ x.T @ jt @ z / t**3 / n**2, z.T @ jt @ x @ jn / t / n
    omega = jn @ a @ np.linalg.inv(b) @ c
    middle = sum((y[i] - fitted[i]) ** 2 * np.outer(x[i] - x.mean(0), x[i] - x.mean(0)) for i in range(t)) / t
    own = omega @ middle @ omega.T
    return own, np.diag(jt @ x @ own @ x.T @ jt) / n**2


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    factor = rng.standard_normal((90, 2))
    x = factor @ rng.standard_normal((2, 7)) + 0.5 * rng.standard_normal((90, 7)) + 3
    z, y = factor + 0.3 * rng.standard_normal((90, 2)), factor @ [1.0, -0.5] + 0.4 * rng.standard_normal(90) + 10
    rows = [(i, *map(float, (y[i], *x[i], *z[i])), 5.0) for i in range(90)]
    names = ["y", *(f"x{k}" for k in range(7)), "z0", "z1", "flat"]
    return y, x, z, spark.createDataFrame(rows, "t int, " + ", ".join(f"{n} double" for n in names)).repartition(4)


XS = [f"x{k}" for k in range(7)]


def columns(df, *names):
    return [np.array([r[n] for r in df.orderBy("t").collect()]) for n in names]


def test_given_proxies(panel):
    y, x, z, df = panel
    phi, sigma, beta, fitted = three_passes(y, x, z)
    e = factors.estimate(df, "y", XS, ["z0", "z1"], variance=True)
    np.testing.assert_allclose(e.phi, phi, atol=1e-9)
    np.testing.assert_allclose(e.beta, beta, atol=1e-9)
    got_y, got, left, f0, f1, v = columns(e.rows(df, ["t"]), "y", "fitted", "residual", "f0", "f1", "variance")
    np.testing.assert_allclose(np.stack([f0, f1], 1), sigma, atol=1e-9)
    np.testing.assert_allclose(got, fitted, atol=1e-9)
    np.testing.assert_allclose(got_y - left, fitted, atol=1e-9)
    own, each = variance(y, x, z, fitted)
    np.testing.assert_allclose(e.alpha_variance, own, rtol=1e-7, atol=1e-12)
    np.testing.assert_allclose(v, each, rtol=1e-7, atol=1e-12)
    r2 = 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert e.r_squared == pytest.approx(r2) and e.adjusted == pytest.approx(1 - (1 - r2) * 89 / 87)
    scaled = x / x.std(0, ddof=1)
    want = [np.corrcoef(scaled[:, k], np.column_stack([np.ones(90), z]) @ np.linalg.lstsq(np.column_stack([np.ones(90), z]), scaled[:, k], rcond=None)[0])[0, 1] ** 2 for k in range(7)]
    np.testing.assert_allclose(e.column_r_squared, want, atol=1e-9)
    old = regression.three_pass_filter(df, "y", XS, ["z0", "z1"])
    np.testing.assert_allclose(old.alpha, e.alpha, atol=1e-10)


@pytest.mark.parametrize("count", [1, 2, 3])
def test_automatic_proxies(panel, count):
    y, x, _, df = panel
    z = y[:, None]
    for _ in range(count):
        phi, sigma, beta, fitted = three_passes(y, x, z)
        used, z = z, np.column_stack([z, y - fitted])
    e = factors.estimate(df, "y", XS, proxies=count, variance=True)
    np.testing.assert_allclose(columns(e.rows(df, ["t"]), "fitted")[0], fitted, atol=1e-8)
    np.testing.assert_allclose(e.beta[0] + columns(e.rows(df, ["t"]), *(f"f{k}" for k in range(count)))[0] * e.beta[1] if count == 1 else fitted, fitted, atol=1e-8)
    np.testing.assert_allclose(e.alpha_variance, variance(y, x, used, fitted)[0], rtol=1e-6, atol=1e-10)


def test_constant_columns_and_gaps(panel, spark):
    y, x, z, df = panel
    e = factors.estimate(df, "y", [*XS, "flat"], ["z0", "z1"])
    assert np.isfinite(e.alpha).all() and np.isfinite(e.r_squared) and abs(e.alpha[-1]) < 10
    assert np.isfinite(regression.three_pass_filter(df, "y", [*XS, "flat"], ["z0", "z1"]).alpha).all()
    gaps = df.selectExpr("t", "IF(t < 5, NULL, y) AS y", "IF(t = 7, double('NaN'), x0) AS x0", *XS[1:], "z0", "z1")
    keep = [i for i in range(90) if i >= 5 and i != 7]
    *_, fitted = three_passes(y[keep], x[keep], z[keep])
    got = columns(factors.estimate(gaps, "y", XS, ["z0", "z1"]).rows(gaps, ["t"]), "fitted")[0]
    np.testing.assert_allclose(got[keep], fitted, atol=1e-9)
    with pytest.raises(ValueError):
        factors.estimate(df.limit(0), "y", XS, ["z0"])
