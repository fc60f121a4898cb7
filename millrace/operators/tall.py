"""Tall matrices (many rows, few columns) as tables of DOUBLE columns: QR, SVD and least squares without a Gram matrix.

A task folds its Arrow batches into one small triangle R with the same R'R as its rows; the
triangles of all tasks are combined FAN at a time, in tasks again, until one is left. Moments
are combined in the same tree. The condition number is not squared, rows stay where they are,
and only k x k matrices (k at most SMALL) meet in a task or reach the driver.

NULL counts as NaN, and a NaN makes the factors NaN, as it does with LAPACK.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.shared import dropped, stored

#: Columns of a tall matrix at most.
SMALL = 512
#: Small matrices that one task combines in each round.
FAN = 16


def checked(columns: list[str]) -> list[str]:
    if not columns or len(columns) > SMALL:
        raise ValueError(f"a tall matrix has 1 to {SMALL} columns")
    return columns


def doubles(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """keep and the columns as DOUBLE; one that is asked for twice comes twice."""
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("double").alias(f"__{k}") for k, c in enumerate(columns)])


def array_of(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """[row, column] of a batch's columns from `first` on."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]], 1) if batch.num_rows else np.empty((0, batch.num_columns - first))


def triangle(x: np.ndarray) -> np.ndarray:
    """The k x k upper triangle R of x = QR with a diagonal that is not negative; rows of zeros where x has fewer rows."""
    k = x.shape[1]
    if np.isnan(x).any():
        return np.triu(np.full((k, k), np.nan))
    out = np.zeros((k, k))
    r = np.linalg.qr(x, mode="r")
    out[: len(r)] = np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] * r
    return out


def combined(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """parts: m (an array as bytes), a row for each task. What merge makes of all of them, FAN at a time; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for m in batch.column(0).to_pylist():
                held.append(np.frombuffer(m))
                if len(held) == FAN:
                    held = [merge(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([merge(held).tobytes()], pa.binary())], names=["m"])

    table = stored(parts, "parts")
    n = table.count()
    while n > FAN:
        before, n = table, -(-n // FAN)
        table = stored(table.repartition(n).mapInArrow(run, "m binary"), "parts")
        dropped(before)
    rows = [np.frombuffer(r["m"]) for r in table.collect()]  # FAN small matrices at most
    dropped(table)
    return merge(rows) if rows else None


def folded(df: DataFrame, add: Callable[[np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """A row m for each task that has rows: add() folded over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(state, array_of(batch))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(state).tobytes()], pa.binary())], names=["m"])

    return df.mapInArrow(run, "m binary")


def r_factor(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of the QR decomposition of the columns; zeros for a table without rows."""
    k = len(checked(columns))
    add = lambda r, x: triangle(x if r is None else np.vstack([r, x]))
    found = combined(folded(doubles(df, columns), add), lambda ms: triangle(np.vstack([m.reshape(k, k) for m in ms])))
    return np.zeros((k, k)) if found is None else found.reshape(k, k)


def times(df: DataFrame, columns: list[str], keep: list[str], steps: list[tuple[str, np.ndarray]], names: list[str]) -> DataFrame:
    """keep and the rows of the columns after some steps: ("solve", r) is x r^-1, ("times", m) is x m."""
    base = doubles(df, columns, keep)
    schema = T.StructType([*base.schema.fields[: len(keep)], *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = array_of(batch, len(keep))
            for kind, m in steps:
                x = x @ m if kind == "times" else np.linalg.solve(m.T, x.T).T
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=schema.names)

    return base.mapInArrow(run, schema)


def qr(df: DataFrame, columns: list[str], keep: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Q (keep, and a column for each of the columns, under its name) and R of a matrix of full column rank.

    Q is x R^-1, decomposed and solved once more, so that its columns are orthogonal to
    rounding up to condition numbers of about 1e15. Without full rank: ValueError.
    """
    first = r_factor(df, columns)
    size = np.abs(np.diag(first))
    if not np.isnan(size).any() and not size.min() > 1e-15 * size.max():
        raise ValueError("the columns are linearly dependent")
    names = [f"q{k}" for k in range(len(columns))]
    second = r_factor(times(df, columns, [], [("solve", first)], names), names)
    return times(df, columns, keep, [("solve", first), ("solve", second)], columns), second @ first


def svd(df: DataFrame, columns: list[str], keep: list[str], k: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U (keep and u0, u1 ... for each row), the k largest singular values (all if None) and the rows of V'.

    From R = U' S V', so that small singular values keep their digits; vectors whose value is
    under 1e-13 of the first have zeros in U.
    """
    _, s, vt = np.linalg.svd(r_factor(df, columns))
    s, vt = s[:k], vt[:k]
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])  # the largest part of each vector of V is positive
    vt = vt * np.where(sign == 0, 1.0, sign)[:, None]
    inverse = np.where(s > 1e-13 * (s[0] if len(s) else 0), 1 / np.where(s == 0, 1, s), 0.0)
    return times(df, columns, keep, [("times", vt.T * inverse)], [f"u{j}" for j in range(len(s))]), s, vt


def singular_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(k, value) in descending order."""
    s = np.linalg.svd(r_factor(df, columns), compute_uv=False)
    return df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "k int, value double")


def rank(df: DataFrame, columns: list[str], rcond: float = 1e-13) -> int:
    """Singular values above rcond times the first."""
    s = np.linalg.svd(r_factor(df, columns), compute_uv=False)
    return int((s > rcond * s[0]).sum())


def pinv(df: DataFrame, columns: list[str], keep: list[str], rcond: float = 1e-13) -> DataFrame:
    """keep and the columns of the pseudo-inverse, transposed: a row for each row, under the columns' names."""
    _, s, vt = np.linalg.svd(r_factor(df, columns))
    good = s > rcond * s[0]
    return times(df, columns, keep, [("times", vt[good].T / s[good]), ("times", vt[good] / s[good][:, None])], columns)


@dataclass
class LeastSquares:
    coefficients: np.ndarray  # of the columns, then the intercept if there is one
    rank: int
    singular_values: np.ndarray
    residual: float  # sum of squares


def least_squares(df: DataFrame, y: str, columns: list[str], intercept: bool = False, rcond: float = 1e-13) -> LeastSquares:
    """The shortest coefficients of the least sum of squares, from the triangle of columns and y together; singular values under rcond of the first count as 0."""
    from_ = df.withColumn("__one", F.lit(1.0)) if intercept else df
    names = [*columns, *(["__one"] if intercept else [])]
    r = r_factor(from_, [*names, y])
    k = len(names)
    u, s, vt = np.linalg.svd(r[:k, :k])
    good = s > rcond * (s[0] if len(s) else 0)
    part = (u.T @ r[:k, k])[good]
    lost = (u.T @ r[:k, k])[~good]
    return LeastSquares(vt[good].T @ (part / s[good]), int(good.sum()), s, float(r[k, k] ** 2 + lost @ lost))


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of products of what is over the means; batches and tasks are merged by their counts, so that large means cost no digits."""
    k = len(checked(columns))
    pack = lambda n, mean, c: np.concatenate([[n], mean, c.ravel()])
    parts = lambda m: (m[0], m[1 : 1 + k], m[1 + k :].reshape(k, k))

    def merge(ms: list[np.ndarray]) -> np.ndarray:
        n, mean, c = parts(ms[0])
        for other in ms[1:]:
            n2, mean2, c2 = parts(other)
            d, total = mean2 - mean, n + n2
            mean, c, n = mean + d * (n2 / total), c + c2 + np.outer(d, d) * (n * n2 / total), total
        return pack(n, mean, c)

    def add(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        mean = x.mean(0)
        own = pack(float(len(x)), mean, (x - mean).T @ (x - mean))
        return own if state is None else merge([state, own])

    found = combined(folded(doubles(df, columns), add), merge)
    if found is None:
        return 0, np.full(k, np.nan), np.zeros((k, k))
    n, mean, c = parts(found)
    return int(n), mean, c
