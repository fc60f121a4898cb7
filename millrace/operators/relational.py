"""Grouping, merging, ordering and stacking of tables with an explicit row order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ieee import NAN


def _nan_skipping_min(c: Column) -> Column:
    return F.min(c)  # NaN is above all, so that a minimum passes it over


AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "min": _nan_skipping_min, "max": F.max,
    "count": lambda c: F.count(F.lit(1)), "std": F.stddev_pop,
}


def group_by(df: DataFrame, key: str, ops: str | Mapping[str, str] = "mean", order: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Aggregates columns by a key of any type, in one pass with partial sums.

    ops: one of mean, sum, min, max, count and std (population) for all other columns, kept
    under their names; or a map from column to op, giving `<column>_<op>` in df's column
    order. order: a column whose least value in a group, as `first_seen`, tells the order
    of first appearance. NaN propagates through all but min and count.
    """
    if isinstance(ops, str):
        names = columns or [c for c in df.columns if c not in (key, order)]
        found = [AGGREGATES[ops](F.col(c)).alias(c) for c in names]
    else:
        unknown = set(ops) - set(df.columns)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        found = [AGGREGATES[ops[c]](F.col(c)).alias(f"{c}_{ops[c]}") for c in df.columns if c in ops]
    if key not in df.columns:
        raise KeyError(key)
    return df.groupBy(key).agg(*found, *([F.min(order).alias("first_seen")] if order else []))


def merge(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Equi-join on one key: the key once and first, clashing names with _x and _y, gaps in DOUBLE columns NaN.

    A NaN key matches nothing; outer joins keep its row. Spark picks the join: nothing is forced to be broadcast.
    """
    double = dict(left.dtypes).get(on) in ("double", "float")
    clash = (set(left.columns) & set(right.columns)) - {on}
    a = left.select(F.col(on).alias("__k"), *[F.col(c).alias(f"{c}_x" if c in clash else c) for c in left.columns if c != on])
    b = right.select(F.col(on).alias("__r"), *[F.col(c).alias(f"{c}_y" if c in clash else c) for c in right.columns if c != on])
    match = F.col("__k") == F.col("__r")
    if double:
        match &= ~F.isnan("__k")
    out = a.join(b, match, how)
    out = out.select(F.coalesce("__k", "__r").alias(on), *[c for c in out.columns if c not in ("__k", "__r")])
    filled = [c for c, t in out.dtypes if t in ("double", "float") and c != on] if how != "inner" else []
    return out.withColumns({c: F.coalesce(c, F.lit(NAN)) for c in filled})


def sort_key(df: DataFrame, spec: str) -> list[Column]:
    """`i,-j` (column positions, minus for descending) as sort expressions: cells that are numbers come first, by value."""
    out = []
    for part in spec.split(","):
        down = part.strip().startswith("-")
        c = F.col(df.columns[int(part.strip().lstrip("-"))])
        number = c.try_cast("double")
        out += [number.desc_nulls_last() if down else number.asc_nulls_last(), c.desc() if down else c.asc()]
    return out


def largest(df: DataFrame, value: str, n: int, ties: str, ascending: bool = False) -> DataFrame:
    """The n largest (or smallest) values; Spark keeps n rows a partition. NaN is largest. Ties go by another column."""
    return df.orderBy(F.col(value).asc() if ascending else F.col(value).desc(), ties).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value and n, to be ordered by n descending and value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def vstack(frames: list[DataFrame], order: str) -> DataFrame:
    """Rows of all frames: `part` tells the frame and `order` the place in it."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("part", F.lit(k))
        out = f if out is None else out.unionByName(f)
    return out


def hstack(a: DataFrame, b: DataFrame, rid: str) -> DataFrame:
    """Columns of both at equal row ids; names of b that clash get _y."""
    renamed = b.select(rid, *[F.col(c).alias(f"{c}_y" if c in a.columns else c) for c in b.columns if c != rid])
    return a.join(renamed, rid)


def bad_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, bad): cells, and those that are NULL, blank or NaN."""
    kinds = dict(df.dtypes)
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    bad = lambda c: blank(c) | F.isnan(c) if kinds[c] in ("double", "float") else blank(c)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(bad(c)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("__n").alias("n"), F.col(f"`{c}`").alias("bad")) for c in columns])).alias("x")).select("x.*")
