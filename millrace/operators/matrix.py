"""Matrices as cells (i, j, v) and as row vectors (rid, row); sizes on the driver only where they are small by contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a matrix whose Gram matrix (this squared) may be solved on the driver.
SMALL = 512


def cells(df: DataFrame, rid: str, row: str) -> DataFrame:
    """(i, j, v) of row vectors."""
    return df.select(F.col(rid).alias("i"), F.posexplode(row).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def rows(df: DataFrame) -> DataFrame:
    """(rid, row) of cells; a row is gathered whole, so that its width must fit a task."""
    return df.groupBy(F.col("i").alias("rid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("row"))


def shape(m: DataFrame) -> DataFrame:
    """One row: rows, columns (the largest places and one more), size, and cells that are there."""
    rows, columns = F.coalesce(F.max("i") + 1, F.lit(0)).cast("long"), F.coalesce(F.max("j") + 1, F.lit(0)).cast("long")
    return m.agg(rows.alias("rows"), columns.alias("columns"), (rows * columns).alias("size"), F.count(F.lit(1)).alias("cells"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum over k of a[i, k] b[k, j]; partial sums are made before the shuffle by (i, j)."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def elementwise(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f over cells of two matrices of one shape."""
    return a.join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"]).select("i", "j", f(F.col("v"), F.col("w")).alias("v"))


def reshape(m: DataFrame, columns: int, new_columns: int) -> DataFrame:
    at = F.col("i") * columns + F.col("j")
    return m.select(F.floor(at / new_columns).alias("i"), (at % new_columns).alias("j"), "v")


def tril(m: DataFrame, k: int = 0) -> DataFrame:
    return m.withColumn("v", F.when(F.col("j") <= F.col("i") + k, F.col("v")).otherwise(0.0))


def triu(m: DataFrame, k: int = 0) -> DataFrame:
    return m.withColumn("v", F.when(F.col("j") >= F.col("i") + k, F.col("v")).otherwise(0.0))


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j").select("i", "v")


def trace(m: DataFrame) -> DataFrame:
    return m.where("i = j").agg(F.sum("v").alias("trace"))


def norm(m: DataFrame, kind: str = "fro") -> DataFrame:
    """fro; inf: the largest row sum of absolute values; 1: the largest column sum."""
    if kind == "fro":
        return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return m.groupBy("i" if kind == "inf" else "j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))


def kron(a: DataFrame, b: DataFrame, shape_b: tuple[int, int]) -> DataFrame:
    """Kronecker product; b must be small (at most SMALL squared cells) and is sent to all tasks."""
    if shape_b[0] * shape_b[1] > SMALL * SMALL:
        raise ValueError("the second factor is too large to be sent to all tasks")
    small = F.broadcast(b.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("bv")))
    return a.crossJoin(small).select((F.col("i") * shape_b[0] + F.col("bi")).alias("i"), (F.col("j") * shape_b[1] + F.col("bj")).alias("j"), (F.col("v") * F.col("bv")).alias("v"))


def repeat_rows(m: DataFrame, n: int) -> DataFrame:
    return m.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select((F.col("i") * n + F.col("__k")).alias("i"), "j", "v")


def repeat_columns(m: DataFrame, n: int) -> DataFrame:
    return m.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("i", (F.col("j") * n + F.col("__k")).alias("j"), "v")


def tile(m: DataFrame, shape: tuple[int, int], down: int, across: int) -> DataFrame:
    out = m.withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return out.select((F.col("i") + F.col("__a") * shape[0]).alias("i"), (F.col("j") + F.col("__b") * shape[1]).alias("j"), "v")


def pick(m: DataFrame, rows: list[int] | None = None, columns: list[int] | None = None) -> DataFrame:
    """Cells of these rows and columns in the order given, which becomes their new index; repeated ones come again. None: all, as they are."""
    out = m
    for axis, wanted in (("i", rows), ("j", columns)):
        if wanted is not None:
            places = F.broadcast(m.sparkSession.createDataFrame([(int(w), k) for k, w in enumerate(wanted)], f"{axis} long, __at long"))  # as long as the list given
            out = out.join(places, axis).withColumn(axis, F.col("__at")).drop("__at")
    return out.select("i", "j", "v")


def part(m: DataFrame, shape: tuple[int, int], rows: tuple[int | None, int | None] = (None, None), columns: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Cells of half-open ranges, counted from the end where negative; indices start at 0 again."""
    (a, b), (c, d) = (tuple(x if x is not None else e for x, e in zip(r, (0, n))) for r, n in zip((rows, columns), shape))
    a, b, c, d = a + shape[0] * (a < 0), b + shape[0] * (b < 0), c + shape[1] * (c < 0), d + shape[1] * (d < 0)
    inside = (F.col("i") >= a) & (F.col("i") < b) & (F.col("j") >= c) & (F.col("j") < d)
    return m.where(inside).select((F.col("i") - a).alias("i"), (F.col("j") - c).alias("j"), "v")


def split(m: DataFrame, at: list[int], axis: int = 0) -> DataFrame:
    """Cells with `part`, the block between cut points (ascending) of an axis that they lie in; indices start at 0 in each."""
    c, cuts = F.col("ij"[axis]), F.array(*[F.lit(int(x)).cast("long") for x in at])
    begin = F.element_at(F.concat(F.array(F.lit(0).cast("long")), cuts), F.col("part") + 1)
    return m.withColumn("part", F.size(F.filter(cuts, lambda x: x <= c)) if at else F.lit(0)).withColumn("ij"[axis], c - begin).select("part", "i", "j", "v")


def split_evenly(m: DataFrame, n: int, size: int, axis: int = 0) -> DataFrame:
    if n < 1 or size % n:
        raise ValueError(f"{size} can't be split into {n} equal parts")
    return split(m, [size // n * k for k in range(1, n)], axis)


def broadcast_to(m: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Cells repeated along axes of size 1."""
    if any(a != b and a != 1 for a, b in zip(shape, to)):
        raise ValueError(f"{shape} can't become {to}")
    out = m
    for axis, a, b in zip("ij", shape, to):
        if a != b:
            out = out.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long")))) if b else out.limit(0)
    return out.select("i", "j", "v")


def with_each(m: DataFrame, vector: DataFrame, axis: int, f) -> DataFrame:
    """f(cell, item) with a vector (i, v) along the columns of each row (axis 1) or the rows of each column (axis 0)."""
    c = "ji"[axis == 0]
    return m.join(vector.select(F.col("i").alias(c), F.col("v").alias("__w")), c).select("i", "j", f(F.col("v"), F.col("__w")).alias("v"))


def along(m: DataFrame, axis: int, f: Column) -> DataFrame:
    """(i, v): an aggregate of column v for each column (axis 0) or row (axis 1), with partial aggregates before the shuffle."""
    return m.groupBy(F.col("ji"[axis]).alias("i")).agg(f.alias("v"))


def lanes(m: DataFrame, axis: int, f) -> DataFrame:
    """f from an array of one column's cells (axis 0) or one row's (axis 1), in order, to an array: as cells again. A lane must fit a task."""
    key, other = ("j", "i") if axis == 0 else ("i", "j")
    lane = F.transform(F.array_sort(F.collect_list(F.struct(other, "v"))), lambda x: x["v"])
    out = m.groupBy(key).agg(lane.alias("__lane")).select(key, F.posexplode(f(F.col("__lane"))).alias("__at", "v"))
    return out.select(F.col(key), F.col("__at").cast("long").alias(other), "v").select("i", "j", "v")


def over_axis(m: DataFrame, axis: int, f) -> DataFrame:
    """f(window) as the new v, the window running down each column (axis 0) or along each row (axis 1), a lane being a partition."""
    key, other = ("j", "i") if axis == 0 else ("i", "j")
    return m.withColumn("v", f(Window.partitionBy(key).orderBy(other)))


def cumulative(m: DataFrame, axis: int, how: str = "sum") -> DataFrame:
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    return over_axis(m, axis, lambda w: fold("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def difference(m: DataFrame, axis: int) -> DataFrame:
    """Each cell less the one before it along the axis; the first row (column) goes."""
    c = "ij"[axis]
    return over_axis(m, axis, lambda w: F.col("v") - F.lag("v").over(w)).where(F.col(c) > 0).withColumn(c, F.col(c) - 1)


def pct_change(m: DataFrame, axis: int) -> DataFrame:
    """(x - before) / before along the axis; NaN where that is NaN, 0 or not there."""
    def f(w):
        before = F.lag("v").over(w)
        return F.when(before.isNull() | F.isnan(before) | (before == 0), float("nan")).otherwise(F.try_divide(F.col("v") - before, before))

    return over_axis(m, axis, f)


def shifted(m: DataFrame, n: int, axis: int, fill: float = float("nan")) -> DataFrame:
    """Cells n places further along the axis, the fill where nothing is."""
    return over_axis(m, axis, lambda w: F.lag("v", n, fill).over(w) if n >= 0 else F.lead("v", -n, fill).over(w))


def ordered(m: DataFrame, axis: int) -> DataFrame:
    """Cells of each column (axis 0) or row (axis 1) in ascending order, NaN last."""
    key, other = ("j", "i") if axis == 0 else ("i", "j")
    place = F.row_number().over(Window.partitionBy(key).orderBy("v", other)) - 1
    return m.withColumn(other, place.cast("long")).select("i", "j", "v")


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells a[i] b[j] of two vectors (i, v): one for each pair by definition."""
    return a.select("i", F.col("v").alias("__a")).crossJoin(b.select(F.col("i").alias("j"), F.col("v").alias("__b"))).select("i", "j", (F.col("__a") * F.col("__b")).alias("v"))


def cross(a: Column, b: Column) -> Column:
    """The cross product of two arrays of three items."""
    at = lambda x, y: a[x] * b[y] - a[y] * b[x]
    return F.array(at(1, 2), at(2, 0), at(0, 1))


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of one length."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once a row, not once for each item of an inner loop."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _total(row: Column) -> Column:
    return F.aggregate(row, F.lit(0.0), lambda s, x: s + x)


def softmax(row: Column) -> Column:
    """Of an array, after its largest item is taken away."""
    row = row.cast("array<double>")
    up = let(F.array_max(row), lambda m: F.transform(row, lambda x: F.exp(x - m)))
    return let(up, lambda u: let(_total(u), lambda t: F.transform(u, lambda x: x / t)))


def log_softmax(row: Column) -> Column:
    row = row.cast("array<double>")
    less = let(F.array_max(row), lambda m: F.transform(row, lambda x: x - m))
    return let(less, lambda u: let(F.ln(_total(F.transform(u, lambda x: F.exp(x)))), lambda t: F.transform(u, lambda x: x - t)))


def argsort(row: Column) -> Column:
    """The 0-based stable order of an array."""
    return F.transform(F.array_sort(F.transform(row, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def convolve(signal: DataFrame, kernel: list[float], mode: str = "full", n: int | None = None) -> DataFrame:
    """Convolution of (i, v) with a short kernel: each item spreads to its places and they are summed.

    full: all places. same: as many as the longer of both has, from the middle. valid: where
    they overlap whole. The last two need n, the signal's length.
    """
    k = F.array(*[F.lit(float(x)) for x in kernel])
    out = signal.select("i", "v", F.posexplode(k).alias("k", "w")).groupBy((F.col("i") + F.col("k")).alias("i")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    if mode == "full":
        return out
    if n is None or mode not in ("same", "valid"):
        raise ValueError("mode is full, same or valid, and the last two need n")
    size = max(n, len(kernel)) if mode == "same" else max(n, len(kernel)) - min(n, len(kernel)) + 1
    low = (n + len(kernel) - 1 - size) // 2 if mode == "same" else min(n, len(kernel)) - 1
    return out.where((F.col("i") >= low) & (F.col("i") < low + size)).select((F.col("i") - low).alias("i"), "v")


def correlate(signal: DataFrame, kernel: list[float], n: int, mode: str = "valid") -> DataFrame:
    """Cross-correlation of a signal of n items with a kernel that is not longer: place i of `valid` is the sum of v[i + k] kernel[k]; modes as in convolve()."""
    if len(kernel) > n:
        raise ValueError("the kernel is longer than the signal")
    return convolve(signal, kernel[::-1], mode, n)
