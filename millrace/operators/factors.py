"""The three-pass regression filter with all of its results, with given proxies or ones that it builds itself.

One pass over the rows gives their moments. Automatic proxies are the target and then the
residuals of each fit; what they have in common with the columns follows from the moments and
the weights of the fit before, so that a round costs no pass. The variance of the weights
takes one more pass, for the columns' moments weighted by squared residuals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.operators import tall
from millrace.operators.regression import _alpha, centred_moments, complete, deviations


@dataclass
class Estimate:
    y: str
    xs: list[str]
    n: int
    proxies: int
    intercept: float
    alpha: np.ndarray  # of the columns as they are
    scaled_alpha: np.ndarray  # of the columns over their standard deviation
    scale: np.ndarray
    means: np.ndarray  # of y, then of the columns
    r_squared: float
    adjusted: float  # for the number of proxies
    phi: np.ndarray  # [column, proxy] slopes of the scaled columns on the proxies
    column_r_squared: np.ndarray  # of those regressions
    loading: np.ndarray  # [column, proxy]: factors are scaled columns times this
    beta: np.ndarray  # of y on the factors: intercept, then a slope for each
    alpha_variance: np.ndarray | None = field(default=None)  # asymptotic, of scaled_alpha

    def rows(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep, y, fitted, residual, the factors f0 ... and, where the variance was asked for, the variance of fitted."""
        base = tall.doubles(df, [self.y, *self.xs], keep)
        names = ["y", "fitted", "residual", *(f"f{k}" for k in range(self.proxies)), *(["variance"] if self.alpha_variance is not None else [])]
        schema = T.StructType([*base.schema.fields[: len(keep)], *(T.StructField(n, T.DoubleType()) for n in names)])
        at, own = len(keep), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = tall.array_of(batch, at)
                y, x = values[:, 0], values[:, 1:]
                fitted = own.intercept + x @ own.alpha
                centred = (x - own.means[1:]) / own.scale
                more = [((centred @ own.alpha_variance) * centred).sum(1) / len(own.xs) ** 2] if own.alpha_variance is not None else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(np.ascontiguousarray(c)) for c in (y, fitted, y - fitted, *(x / own.scale @ own.loading).T, *more))], names=schema.names)

        return base.mapInArrow(run, schema)


def estimate(df: DataFrame, y: str, xs: list[str], zs: list[str] | None = None, proxies: int = 1, variance: bool = False) -> Estimate:
    """The filter over rows without a NaN or NULL in the columns used, at most SMALL of them.

    zs: columns of proxies; None: `proxies` automatic ones. A constant column weighs nothing.
    No rows: ValueError.
    """
    means, c, n = centred_moments(df, [y, *xs, *(zs or [])])
    if not n:
        raise ValueError("no complete row")
    k = len(xs)
    x = slice(1, 1 + k)
    d = deviations(np.diag(c)[x], means[x], n)
    sxx, sxy, syy = c[x, x] / np.outer(d, d), c[x, 0] / d, float(c[0, 0])
    if zs:
        sxz, szz = c[x, 1 + k :] / d[:, None], c[1 + k :, 1 + k :]
        weights = _alpha(sxx, sxz - sxz.mean(0), sxy)
    else:
        # Proxy 0 is y; proxy j is y less the fit with those before: its products with anything are y's less those of the fit.
        fits = [np.zeros(k)]
        for _ in range(proxies):
            sxz = np.stack([sxy - sxx @ f for f in fits], 1)
            fits.append(_alpha(sxx, sxz - sxz.mean(0), sxy))
        weights, fits = fits[-1], np.stack(fits[:-1], 1)
        szz = syy - (fits.T @ sxy)[:, None] - (fits.T @ sxy)[None] + fits.T @ sxx @ fits
    count = sxz.shape[1]
    r2 = float(2 * weights @ sxy - weights @ sxx @ weights) / syy if syy else 0.0
    phi = np.linalg.lstsq(szz, sxz.T, rcond=1e-13)[0].T
    own = np.diag(sxx)
    column_r2 = np.where(own > 0, (phi * sxz).sum(1) / np.where(own > 0, own, 1), 0.0)
    centred = phi - phi.mean(0)
    loading = np.linalg.lstsq(centred.T @ centred, centred.T, rcond=1e-13)[0].T
    slopes = np.linalg.lstsq(loading.T @ sxx @ loading, loading.T @ sxy, rcond=1e-13)[0]
    beta = np.append(means[0] - slopes @ (loading.T @ (means[x] / d)), slopes)
    alpha = weights / d
    out = Estimate(y, xs, n, count, float(means[0] - alpha @ means[x]), alpha, weights, d, means[: 1 + k], r2, 1 - (1 - r2) * (n - 1) / (n - count - 1) if n > count + 1 else 0.0, phi, column_r2, loading, beta)
    if variance:
        out.alpha_variance = _variance(df, out, sxz, sxx)
    return out


def _variance(df: DataFrame, fit: Estimate, sxz: np.ndarray, sxx: np.ndarray) -> np.ndarray:
    n, k = fit.n, len(fit.xs)
    good, names = complete(df, [fit.y, *fit.xs])

    def add(state: np.ndarray | None, values: np.ndarray) -> np.ndarray:
        x = (values[:, 2:] - fit.means[1:]) / fit.scale
        e = values[:, 1] - fit.intercept - values[:, 2:] @ fit.alpha
        own = (x * (e * e)[:, None]).T @ x
        return own if state is None else state.reshape(k, k) + own

    middle = tall.combined(tall.folded(tall.doubles(good, names), add), lambda ms: np.sum(ms, 0)).reshape(k, k) / n
    across = lambda m: m - m.mean(1, keepdims=True)  # noqa: E731  each row less its mean
    a, b, c = sxz / n, across(sxz.T) @ across(sxx) @ sxz / n**3 / k**2, across(sxz.T) / n / k
    omega = a @ np.linalg.solve(b, c)
    omega = omega - omega.mean(0)
    return omega @ middle @ omega.T
