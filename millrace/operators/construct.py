"""Matrices and vectors made by a rule, as cells (i, j, v) and as indexed rows (i, v), by tasks and not on the driver.

Sizes may be numbers or columns of a one-row table, so that a matrix can be as large as the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def indices(spark: SparkSession, n: int, name: str = "i") -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))


def tabulate(spark: SparkSession, rows: int, columns: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Cells f(i, j): one task makes a range of cells, and nothing is joined."""
    if rows < 0 or columns < 0:
        raise ValueError("a negative size")
    at = spark.range(rows * columns).select(F.floor(F.col("id") / F.lit(max(1, columns))).alias("i"), (F.col("id") % F.lit(max(1, columns))).alias("j"))
    return at.select("i", "j", f(F.col("i"), F.col("j")).cast("double").alias("v"))


def full(spark: SparkSession, rows: int, columns: int, value: float) -> DataFrame:
    return tabulate(spark, rows, columns, lambda i, j: F.lit(float(value)))


def full_like(m: DataFrame, value: float) -> DataFrame:
    """A cell of the value for each cell of m."""
    return m.select("i", "j", F.lit(float(value)).alias("v"))


def eye(spark: SparkSession, n: int, k: int = 0) -> DataFrame:
    """The cells that are 1 of an n x n matrix with ones k places above the diagonal; the others are not written out."""
    i = F.col("i")
    return indices(spark, n).select("i", (i + k).alias("j"), F.lit(1.0).alias("v")).where((F.col("j") >= 0) & (F.col("j") < n))


def diag(vector: DataFrame) -> DataFrame:
    """The diagonal cells of a vector (i, v); the others are not written out."""
    return vector.select("i", F.col("i").alias("j"), F.col("v").cast("double").alias("v"))


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    """(i, v) of start, start + step, ... before stop."""
    if step == 0:
        raise ValueError("a step of 0")
    n = max(0, -int(-(stop - start) // step))
    return indices(spark, n).select("i", (F.lit(float(start)) + F.col("i") * F.lit(float(step))).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, n: int = 50) -> DataFrame:
    """(i, v) of n points with both ends; one point is the start."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    last = F.when(F.col("i") == n - 1, F.lit(float(stop if n > 1 else start)))
    return indices(spark, n).select("i", F.coalesce(last, F.lit(float(start)) + F.col("i") * F.lit(step)).alias("v"))


def meshgrid(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, x, y) of two vectors (i, v): i goes along y and j along x. The result is a cell for each pair by definition."""
    a = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    b = y.select("i", F.col("v").alias("y"))
    return b.crossJoin(a).select("i", "j", "x", "y")
