"""Operators along a global row order, without a window over one partition.

Rows are cut into ranges of the order column. Windows run inside ranges; what crosses them
is carried by a row for each range (totals, extremes) or by copies of the few rows before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ieee import NAN
from millrace.operators import tall
from millrace.operators.recurrences import bucketed, segments


def ranges(df: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """df with `__range`, 0 to about n, ascending with a number, date or timestamp; bounds are approximate quantiles, equal values stay together."""
    return bucketed(df, order, "__range", n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dense_index(df: DataFrame, order: str, ties: list[str] | None = None, n: int | None = None, name: str = "i") -> DataFrame:
    """df with the 0-based place of each row in the order."""
    cut = ranges(df, order, n)
    counts = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order, *(ties or [])))
    return cut.withColumn("__place", place).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__place") - 1).drop("__range", "__place", "__before")  # before: a row for each range


def running(df: DataFrame, order: str, value: str, how: str = "sum", name: str | None = None, n: int | None = None) -> DataFrame:
    """Running sum, max or min of a column; ranges are scanned apart and a row for each carries what came before."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    cut = ranges(df, order, n)
    totals = cut.groupBy("__range").agg(fold(value).alias("__t"))
    before = totals.withColumn("__b", fold("__t").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__t")
    inside = fold(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    both = cut.withColumn("__in", inside).join(F.broadcast(before), "__range")
    joined = {"sum": F.col("__in") + F.coalesce("__b", F.lit(0)), "max": F.greatest("__in", "__b"), "min": F.least("__in", "__b")}[how]
    return both.withColumn(name or f"cum{how}", joined).drop("__range", "__in", "__b")


def _with_halo(df: DataFrame, index: str, width: int, rows: int) -> DataFrame:
    """Blocks of `rows` dense indices, each with copies (`__copy`) of the `width` rows before it."""
    block = F.floor(F.col(index) / rows)
    own = df.withColumns({"__block": block, "__copy": F.lit(False)})
    halo = df.where(F.col(index) % rows >= rows - width).withColumns({"__block": block + 1, "__copy": F.lit(True)})
    return own.unionByName(halo)


def _near(df: DataFrame, index: str, width: int, make: dict[str, Column], rows: int) -> DataFrame:
    rows = max(rows, width)
    return _with_halo(df, index, width, rows).withColumns(make).where("NOT __copy").drop("__block", "__copy")


def window_of(index: str) -> Window:
    return Window.partitionBy("__block").orderBy(index)


def rolling(df: DataFrame, index: str, value: str, width: int, how: str, name: str | None = None, rows: int = 65_536) -> DataFrame:
    """Trailing window of `width` rows along a dense index: mean, sum, min, max or std (population); NaN in the first width - 1 rows."""
    fold = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}[how]
    c = fold(F.col(value).cast("double")).over(window_of(index).rowsBetween(1 - width, 0))
    return _near(df, index, width - 1, {name or f"rolling_{how}": F.when(F.col(index) < width - 1, NAN).otherwise(c)}, rows)


def trailing_mean(df: DataFrame, index: str, value: str, width: int, name: str = "trailing_mean", rows: int = 65_536) -> DataFrame:
    """As rolling mean, but the first rows average what there is."""
    return _near(df, index, width - 1, {name: F.avg(value).over(window_of(index).rowsBetween(1 - width, 0))}, rows)


def shift(df: DataFrame, index: str, value: str, n: int, fill: float = NAN, name: str = "shifted", rows: int = 65_536) -> DataFrame:
    """The value n rows before; the first n rows get the fill. For n below 0, -n rows after."""
    if n >= 0:
        return _near(df, index, n, {name: F.lag(value, n, fill).over(window_of(index))}, rows)
    there = df.select((F.col(index) + n).alias(index), F.col(value).alias(name))
    return df.join(there, index, "left").withColumn(name, F.coalesce(name, F.lit(fill)))


def difference(df: DataFrame, index: str, value: str, name: str = "diff", rows: int = 65_536) -> DataFrame:
    """value less the one before; one row fewer."""
    return _near(df, index, 1, {name: F.col(value) - F.lag(value).over(window_of(index))}, rows).where(F.col(index) > 0)


def pct_change(df: DataFrame, index: str, value: str, name: str = "pct_change", rows: int = 65_536) -> DataFrame:
    """(x - before) / before; NaN where that is NaN, 0 or not there."""
    before = F.lag(value).over(window_of(index))
    bad = before.isNull() | F.isnan(before) | (before == 0)
    return _near(df, index, 1, {name: F.when(bad, NAN).otherwise(F.try_divide(F.col(value) - before, before))}, rows)


def log_returns(df: DataFrame, index: str, value: str, name: str = "log_return", rows: int = 65_536) -> DataFrame:
    return _near(df, index, 1, {name: F.ln(F.try_divide(F.col(value), F.lag(value).over(window_of(index))))}, rows).where(F.col(index) > 0)


def percentiles_of(df: DataFrame, columns: list[str], ps: list[float], n: int = 64) -> DataFrame:
    """(name, p, value) of columns with linear interpolation, for p in 0 to 100.

    Equal values are counted first, so that a value that most rows have is one row. Each
    column's distinct values are cut into n ranges by approximate quantiles; a row for each
    range carries the rows before it, and only values at the ranks asked for are kept.
    NaN is above all numbers; NULL is left out.
    """
    if any(not 0 <= p <= 100 for p in ps):
        raise ValueError("percentiles are from 0 to 100")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL")
    counts = cells.groupBy("name", "v").agg(F.count(F.lit(1)).alias("k"))
    bounds = counts.groupBy("name").agg(F.approx_percentile("v", [j / n for j in range(1, n)], 1000).alias("bounds"))
    cut = counts.join(F.broadcast(bounds), "name")  # a row for each column
    cut = cut.select("name", "v", "k", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("range"))
    sums = cut.groupBy("name", "range").agg(F.sum("k").alias("t"))
    whole = Window.partitionBy("name")  # n rows for each column
    before = sums.select("name", "range", (F.sum("t").over(whole.orderBy("range")) - F.col("t")).alias("before"), F.sum("t").over(whole).alias("n"))
    upto = F.sum("k").over(Window.partitionBy("name", "range").orderBy("v"))
    rows = cut.withColumn("upto", upto).join(F.broadcast(before), ["name", "range"]).select("name", "v", "n", (F.col("before") + F.col("upto") - F.col("k")).alias("low"), (F.col("before") + F.col("upto")).alias("high"))
    rows = rows.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("r", F.col("p") / 100 * (F.col("n") - 1))
    inside = lambda x: (x >= F.col("low")) & (x < F.col("high"))
    found = rows.where(inside(F.floor("r")) | inside(F.ceil("r")))  # two rows at most for each p asked for
    low, high, share = F.min("v"), F.max("v"), F.max("r") - F.floor(F.max("r"))
    return found.groupBy("name", "p").agg(F.when(low == high, low).otherwise(low + (high - low) * share).alias("value"))


def percentiles(df: DataFrame, value: str, ps: list[float], n: int = 64) -> DataFrame:
    """(p, value) of one column, as percentiles_of()."""
    return percentiles_of(df, [value], ps, n).select("p", "value")


def quantile_nearest(df: DataFrame, value: str, q: float, n: int | None = None) -> DataFrame:
    """The value at rank floor(n q), of the sorted column, at most the last."""
    total = df.count()
    rank = min(int(total * q), total - 1)
    return dense_index(df.select(F.col(value).cast("double").alias("value")), "value", n=n).where(F.col("i") == rank).select("value")


def drawdown(df: DataFrame, index: str, value: str, name: str = "drawdown", n: int | None = None) -> DataFrame:
    """1 - x / running max."""
    return running(df, index, value, "max", "__peak", n).withColumn(name, 1 - F.try_divide(F.col(value), F.col("__peak"))).drop("__peak")


def underwater(df: DataFrame, index: str, value: str, n: int | None = None) -> DataFrame:
    """Stretches below an earlier peak: peak_at, first, last, length, worst depth; a stretch is known by its peak."""
    run = running(df, index, value, "max", "peak", n)
    peaks = run.where(F.col(value) >= F.col("peak")).select("peak", F.col(index).alias("at")).groupBy("peak").agg(F.max("at").alias("peak_at"))
    below = run.where(F.col(value) < F.col("peak")).groupBy("peak").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("length"), F.max(1 - F.try_divide(F.col(value), F.col("peak"))).alias("depth"))
    return below.join(peaks, "peak").select("peak_at", "first", "last", "length", "depth")


def autocorrelation(df: DataFrame, index: str, value: str, lag: int, how: str = "abs") -> DataFrame:
    """Correlation of |x| (or x squared) with itself `lag` rows before, as `autocorr`."""
    x = F.abs(value) if how == "abs" else F.col(value) * F.col(value)
    both = shift(df.withColumn("__x", x), index, "__x", lag, NAN, "__y")
    return both.where(~F.isnan("__y")).agg(F.corr("__x", "__y").alias("autocorr"))


def autocorrelations(df: DataFrame, index: str, value: str, lags: int, how: str = "abs", rows: int = 65_536) -> DataFrame:
    """(lag, autocorr) for lags 1 to `lags`, all in one pass: the correlation of |x| (how = abs), x squared (square) or x (plain) with itself `lag` rows before.

    Blocks of a dense index with copies of the rows before them give their part of all sums of
    products by FFT; the parts are added up. Too few rows for a lag, or a constant, give NULL.
    """
    x = {"abs": F.abs(value), "square": F.col(value) * F.col(value), "plain": F.col(value)}[how].cast("double")
    rows = max(rows, lags)
    base = df.select(F.col(index).cast("long").alias("i"), x.alias("x"))
    n, mean = base.agg(F.count(F.lit(1)), F.avg("x")).first()
    less = base.withColumn("x", F.col("x") - F.lit(mean or 0.0))  # large means cost no digits
    near = _with_halo(less, "i", lags, rows).select("__block", "i", "x", "__copy").repartition("__block").sortWithinPartitions("__block", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments(batches, 1):
            at, v, copy = part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
            if copy.all():
                continue
            own = np.where(copy, 0.0, v)
            size = 1 << int(len(v) + lags).bit_length()
            products = np.fft.irfft(np.fft.rfft(own, size) * np.conj(np.fft.rfft(v, size)), size)[1 : lags + 1]
            # Sums over the rows that have a row `lag` before them, and over those rows.
            lag, late, early = np.arange(1, lags + 1), v[~copy], at[~copy]
            total, square = np.cumsum(late), np.cumsum(late * late)
            upto = np.searchsorted(early, lag)  # own rows before place `lag`
            before = np.searchsorted(early, n - lag)
            ends = lambda s, k: np.append(0.0, s)[k]
            sums = [products, total[-1] - ends(total, upto), ends(total, before), square[-1] - ends(square, upto), ends(square, before)]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums).tobytes()], pa.binary())], names=["m"])

    found = tall.combined(near.mapInArrow(run, "m binary"), lambda ms: np.sum(ms, 0))
    out = []
    for k in range(1, lags + 1):
        if found is None or n - k < 2:
            out.append((k, None))
            continue
        xy, sx, sy, xx, yy = found.reshape(5, lags)[:, k - 1]
        m = n - k
        spread = (xx - sx * sx / m) * (yy - sy * sy / m)
        out.append((k, float((xy - sx * sy / m) / spread**0.5) if spread > 0 else None))
    return df.sparkSession.createDataFrame(out, "lag int, autocorr double")
