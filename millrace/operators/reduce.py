"""Reductions of columns in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import percentiles_of


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value) of each cell of the columns; it stays inside the stage."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.name", "x.value")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count (rows), mean, std (population), min, quartiles by linear interpolation, max."""
    sums = stacked(df, columns).groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = percentiles_of(df, columns, [25.0, 50.0, 75.0]).groupBy("name").pivot("p", [25.0, 50.0, 75.0]).agg(F.max("value"))
    return sums.join(quartiles, "name").select("name", "count", "mean", "std", "min", F.col("`25.0`").alias("p25"), F.col("`50.0`").alias("p50"), F.col("`75.0`").alias("p75"), "max")


def row_sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in columns])


def row_mean(columns: list[str]) -> Column:
    return row_sum(columns) / len(columns)


def row_std(columns: list[str]) -> Column:
    mean = row_mean(columns)
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - mean) * (F.col(c) - mean) for c in columns]) / len(columns))


def row_arg(columns: list[str], largest: bool) -> Column:
    """Position of the first extreme of a row."""
    row = F.array(*[F.col(c).cast("double") for c in columns])
    return F.array_position(row, F.array_max(row) if largest else F.array_min(row)) - 1


def arg_extreme(df: DataFrame, value: str, order: str, largest: bool) -> DataFrame:
    """The row id of the first extreme and its value."""
    best = F.min_by(order, F.struct((-F.col(value) if largest else F.col(value)).alias("v"), F.col(order).alias("o")))
    return df.agg(best.alias("at"), (F.max(value) if largest else F.min(value)).alias("value"))


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin (from 0), left and right edge and count of equal bins, the last closed on the right; values outside are left out.

    Without a range, that of the data; no range at all puts everything into bin 0 with edges 1e-4 apart.
    """
    c = F.col(column).cast("double")
    span = df.agg(F.coalesce(F.lit(low).cast("double"), F.min(c)).alias("lo"), F.coalesce(F.lit(high).cast("double"), F.max(c)).alias("hi"))
    span = F.broadcast(span)  # one row
    rows = df.select(c.alias("v")).crossJoin(span).where("v >= lo AND v <= hi")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1e-4)
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("width"))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def covariance(df: DataFrame, columns: list[str], ddof: int = 1) -> DataFrame:
    """(a, b, cov, corr) of every two columns: centred single-pass aggregates of the upper triangle, from which the rest follows."""
    cov = F.covar_samp if ddof else F.covar_pop
    row = df.agg(*[cov(a, b).alias(f"{a}|{b}") for i, a in enumerate(columns) for b in columns[i:]])
    at = lambda a, b: F.col(f"`{a}|{b}`" if columns.index(a) <= columns.index(b) else f"`{b}|{a}`")
    corr = lambda a, b: F.try_divide(at(a, b), F.sqrt(at(a, a) * at(b, b)))
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), at(a, b).alias("cov"), corr(a, b).alias("corr")) for a in columns for b in columns])).alias("x")).select("x.*")


def variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the population variance of each column."""
    return df.agg(*[F.var_pop(c).alias(c) for c in columns])


def nan_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, std, n) of each column's cells that are not NaN or NULL; std with n - 1."""
    good = stacked(df, columns).where("value IS NOT NULL AND NOT isnan(value)")
    return good.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))


def histogram_of(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bin (from 0), left_edge, right_edge and n of bins between ascending edges, the last closed on the right; values outside and NaN are left out."""
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must be two or more, in ascending order")
    c, every = F.col(column).cast("double"), F.array(*[F.lit(float(e)) for e in edges])
    at = F.least(F.size(F.filter(every, lambda e: e <= F.col("v"))) - 1, F.lit(len(edges) - 2))
    counts = df.select(c.alias("v")).where((F.col("v") >= edges[0]) & (F.col("v") <= edges[-1])).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, left_edge double, right_edge double")
    return bins.join(counts, "bin", "left").select("bin", "left_edge", "right_edge", F.coalesce("n", F.lit(0)).alias("n"))


def scale(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Columns less their mean, over the standard deviation with n - 1; the statistics are one row, sent to all tasks."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"d_{c}") for c in columns])
    return df.crossJoin(F.broadcast(stats)).select(*keep, *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).alias(c) for c in columns])


def kurtosis(c: str | Column) -> Column:
    """The raw ratio of moments, not the excess."""
    return F.kurtosis(c) + 3
