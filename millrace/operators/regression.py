"""Least squares and factor forecasts from the triangle of a tall QR and k x k solves on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import tall


@dataclass
class Fit:
    columns: list[str]
    intercept: float
    coefficients: np.ndarray
    r_squared: float
    adjusted: float
    n: int

    def rows(self, df: DataFrame) -> DataFrame:
        """(term, value) of the fit."""
        found = [("intercept", self.intercept), *zip(self.columns, self.coefficients), ("r_squared", self.r_squared), ("adj_r_squared", self.adjusted)]
        return df.sparkSession.createDataFrame([(k, float(v)) for k, v in found], "term string, value double")


def complete(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """A column of ones and the columns as DOUBLE, in rows without a NaN or NULL in them, and the columns' names."""
    own = [f"x{k}" for k in range(len(names))]  # a column may be asked for twice
    good = df.select(F.lit(1.0).alias("one"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(names, own)]).where(" AND ".join(f"{x} IS NOT NULL AND NOT isnan({x})" for x in own))
    return good, ["one", *own]


def centred_triangle(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, the triangle R of the columns less their means, and the rows without a NaN or NULL in these columns.

    R is what the triangle of a column of ones and the columns has below its first row, so that neither large means nor nearly dependent columns cost digits.
    """
    r = tall.r_factor(*complete(df, names))
    n = round(r[0, 0] ** 2)
    return r[0, 1:] / r[0, 0] if n else np.full(len(names), np.nan), r[1:, 1:], n


def centred_moments(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, sums of centred products, and the rows without a NaN or NULL in these columns, in one pass."""
    n, means, products = tall.moments(*complete(df, names))
    return means[1:], products[1:, 1:], n


def deviations(variances: np.ndarray, means: np.ndarray, n: int) -> np.ndarray:
    """Standard deviations (n - 1) of sums of squares; 1 for a constant column, whose weight is then 0."""
    d = np.sqrt(np.maximum(variances, 0) / max(1, n - 1))
    return np.where(d > 1e-9 * (1 + np.abs(means)), d, 1.0)


def lm(df: DataFrame, y: str, columns: list[str]) -> Fit:
    """Ordinary least squares with an intercept; rows with a NaN or NULL in y or the columns are left out. Of dependent columns the shortest coefficients are given."""
    k = len(columns)
    means, r, n = centred_triangle(df, [*columns, y])
    if not n:
        return Fit(columns, float("nan"), np.full(k, np.nan), float("nan"), float("nan"), 0)
    beta = np.linalg.lstsq(r[:k, :k], r[:k, k], rcond=1e-13)[0] if k else np.empty(0)
    total, left = float(r[:, k] @ r[:, k]), r[:, k] - r[:, :k] @ beta
    r2 = 1 - float(left @ left) / total if total else float("nan")
    return Fit(columns, float(means[k] - beta @ means[:k]), beta, r2, 1 - (1 - r2) * (n - 1) / max(1, n - k - 1), n)


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    """Coefficients of the least-squares polynomial, highest power first."""
    powers = df.select(F.col(y).cast("double").alias("y"), *[F.pow(F.col(x).cast("double"), F.lit(k)).alias(f"x{k}") for k in range(1, degree + 1)])
    fit = lm(powers, "y", [f"x{k}" for k in range(1, degree + 1)])
    return np.append(fit.coefficients[::-1], fit.intercept)


def polyval(coefficients: list[float], x: str):
    """Horner's scheme as an expression."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * F.col(x) + F.lit(float(c))
    return out


@dataclass
class Factor:
    alpha: np.ndarray  # by column of X
    intercept: float
    r_squared: float
    n: int  # rows that it was learnt from


def three_pass_filter(df: DataFrame, y: str, xs: list[str], zs: list[str]) -> Factor:
    """The three-pass regression filter in closed form, from centred moments.

    Rows with a NaN or NULL in any column are left out. Columns of X are scaled to a standard deviation (n - 1) of one; a constant one weighs nothing. alpha = W (W' Sxx W)^-1 W' sxy,
    where W is the cross moments of X and Z less their mean over the columns of X; the fit is
    intercept + X alpha, with alpha given for the unscaled columns.
    """
    means, c, n = centred_moments(df, [y, *xs, *zs])
    p = len(xs)
    d = deviations(np.diag(c)[1 : 1 + p], means[1 : 1 + p], n)
    sxx, sxz, sxy = c[1 : 1 + p, 1 : 1 + p] / np.outer(d, d), c[1 : 1 + p, 1 + p :] / d[:, None], c[1 : 1 + p, 0] / d
    alpha = _alpha(sxx, sxz - sxz.mean(0), sxy)
    r2 = float(2 * alpha @ sxy - alpha @ sxx @ alpha) / c[0, 0]
    beta = alpha / d
    return Factor(beta, float(means[0] - beta @ means[1 : 1 + p]), r2, n)


def _alpha(sxx: np.ndarray, sxz: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Weights of the centred, scaled columns: their projections on the proxies, weighted by least squares of y on the factors."""
    return sxz @ np.linalg.solve(sxz.T @ sxx @ sxz, sxz.T @ sxy)


def pls1(df: DataFrame, y: str, xs: list[str]) -> Factor:
    """One-component partial least squares: the direction of the covariances with y, scaled by least squares."""
    means, c, n = centred_moments(df, [y, *xs])
    w = c[1:, 0]
    beta = w * float(w @ c[1:, 0]) / float(w @ c[1:, 1:] @ w)
    return Factor(beta, float(means[0] - beta @ means[1:]), float(2 * beta @ c[1:, 0] - beta @ c[1:, 1:] @ beta) / c[0, 0], n)
