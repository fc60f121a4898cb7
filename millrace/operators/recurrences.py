"""Recurrences along paths (path, session, value) in which one long path is many tasks.

Sessions are cut into chunks at quantiles, so that a path with a third of all rows has about
as many of each chunk. A chunk of a path is summed up by the map from the state before it to
the state after it: an affine map of a moving average, or, for a held value, the few values
at which a state leaves its band with where it ends. A path's maps, a row for each chunk, are
applied in order; then every chunk runs from its own first state. An expanding median asks
of the rows before a chunk only the counts of values around their median.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.shared import stored

#: Rows of a chunk, about; what a task holds of a path.
ROWS = 200_000


def bucketed(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """df with `name`: which of about n ranges of a number, date or timestamp a row is in, from 0; equal values stay together, NULL is in the first range and NaN in the last.

    Bounds are approximate quantiles; a row finds its range by binary search.
    """
    kind, at = df.schema[column].dataType, F.col(column)
    number = F.unix_date(at).cast("double") if isinstance(kind, T.DateType) else at.cast("timestamp").cast("double") if isinstance(kind, T.TimestampNTZType) else at.cast("double")
    as_double = df.withColumn("__at", F.coalesce(number, F.lit(float("nan"))))
    bounds = sorted({b for b in as_double.where("NOT isnan(__at)").approxQuantile("__at", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    if not bounds:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__at", outputCol="__bucket", handleInvalid="keep").transform(as_double)
    return cut.withColumn(name, F.when(F.col(column).isNull(), 0).otherwise(F.col("__bucket").cast("int"))).drop("__at", "__bucket")


def chunked(df: DataFrame, path: str, column: str, name: str, size: int, n: int) -> DataFrame:
    """df with `name`: each path's rows in chunks along a column, of about `size` rows, from 0; a path with fewer rows is one chunk.

    Chunks are made of n ranges of the column, which are counted for each path.
    """
    cut = bucketed(df, column, "__range", n)
    if n == 1:
        return cut.withColumnRenamed("__range", name)
    counts = cut.groupBy(F.col(path).alias("__p"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__p").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))  # n rows at most
    counts = counts.select("__p", "__r", F.floor(F.coalesce(before, F.lit(0)) / size).cast("int").alias(name))
    return cut.join(counts, F.col(path).eqNullSafe(F.col("__p")) & (F.col("__range") == F.col("__r"))).drop("__p", "__r", "__range")


def ranges_for(df: DataFrame, size: int) -> int:
    return min(4096, max(1, -(-df.count() // size)))


@dataclass(frozen=True)
class Recurrence:
    """summary(values): what a chunk's values (float, NULL as NaN) do; after(state, summary): the state after it (None before a path);
    run(state, values): an output for each value, NaN for NULL."""

    summary: Callable[[np.ndarray], object]
    after: Callable[[object, object], object]
    run: Callable[[object, np.ndarray], np.ndarray]


def segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each key (the first columns) as one batch, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    key_of = lambda batch: tuple(c[0].as_py() for c in batch.columns[:keys])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in batch.columns[:keys]:
            a, b = c.slice(0, n - 1), c.slice(1)
            new[1:] |= np.asarray(pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))), bool)
        starts = [0, *np.flatnonzero(new).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            part = batch.slice(a, b - a)
            if held and key_of(held[0]) != key_of(part):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def along(df: DataFrame, path: str, session: str, value: str, rule: Recurrence, name: str, size: int = ROWS) -> DataFrame:
    """path, session, value (DOUBLE) and the outputs of a recurrence along each path in order of session.

    size: rows of a chunk, about. A task holds one chunk of a path; equal sessions are in one
    chunk. A NaN is no value here and counts as NULL.
    """
    kinds = dict((f.name, f.dataType) for f in df.schema.fields)
    rows = df.select(F.col(path).alias("p"), F.col(session).alias("s"), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("v"))
    cut = stored(chunked(rows, "p", "s", "chunk", size, ranges_for(rows, size)), "chunks")
    dealt = cut.select("p", "chunk", "s", "v").repartition("p", "chunk").sortWithinPartitions("p", "chunk", "s")
    key = T.StructField("p", kinds[path])
    number = T.StructField("chunk", T.IntegerType())
    floats = lambda c: c.to_numpy(zero_copy_only=False).astype(float)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0)[:1], part.column(1)[:1], pa.array([pickle.dumps(rule.summary(floats(part.column(3))))], pa.binary())], names=["p", "chunk", "m"])

    maps = dealt.mapInArrow(sum_up, T.StructType([key, number, T.StructField("m", T.BinaryType())]))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, None, False
        for batch in batches:
            out = []
            for p, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or p != current:
                    current, state, begun = p, None, True
                out.append(None if state is None else pickle.dumps(state))
                state = rule.after(state, pickle.loads(m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["p", "chunk", "state"])

    states = stored(maps.repartition("p").sortWithinPartitions("p", "chunk").mapInArrow(carry, T.StructType([key, number, T.StructField("state", T.BinaryType())])), "states")  # a row for each chunk of a path
    both = cut.join(states, (cut["p"].eqNullSafe(states["p"])) & (cut["chunk"] == states["chunk"])).select(cut["p"], cut["chunk"], "s", "v", "state")
    both = both.repartition("p", "chunk").sortWithinPartitions("p", "chunk", "s")
    schema = T.StructType([T.StructField(path, kinds[path]), T.StructField(session, kinds[session]), T.StructField(value, T.DoubleType()), T.StructField(name, T.DoubleType())])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments(batches, 2):
            state = part.column(4)[0].as_py()
            out = rule.run(None if state is None else pickle.loads(state), floats(part.column(3)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(out, pa.float64(), from_pandas=True)], names=[path, session, value, name])

    return both.mapInArrow(replay, schema)


# --- moving averages: affine maps -----------------------------------------------------


def affine_scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of the maps y -> a y + b up to each place, by doubling."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:], a[step:] = a[step:] * b[:-step] + b[step:], a[step:] * a[:-step]
        step *= 2
    return a, b


def _average(keep: float) -> Recurrence:
    """y = keep * y + (1 - keep) * x from the first x on; the state is y."""

    def maps(x):
        there = ~np.isnan(x)
        return affine_scan(np.where(there, keep, 1.0), np.where(there, (1 - keep) * x, 0.0)), there

    def from_first(x):
        there = np.flatnonzero(~np.isnan(x))
        return (there[0], x[there[0]]) if len(there) else (None, None)

    def summary(x):
        at, first = from_first(x)
        if at is None:
            return None
        (a, b), _ = maps(x)
        fresh, _ = maps(x[at + 1 :])
        return float(a[-1]), float(b[-1]), float(fresh[0][-1] * first + fresh[1][-1]) if len(fresh[0]) else float(first)

    def after(state, m):
        return state if m is None else m[2] if state is None else m[0] * state + m[1]

    def run(state, x):
        out = np.full(len(x), np.nan)
        if state is not None:
            (a, b), _ = maps(x)
            return a * state + b
        at, first = from_first(x)
        if at is not None:
            out[at] = first
            (a, b), _ = maps(x[at + 1 :])
            out[at + 1 :] = a * first + b
        return out

    return Recurrence(summary, after, run)


def ewma(df: DataFrame, path: str, session: str, value: str, keep: float, size: int = ROWS) -> DataFrame:
    """Exponentially weighted mean of each path: keep * before + (1 - keep) * x, from the first value. NULL changes nothing."""
    return along(df, path, session, value, _average(keep), "ewma", size)


def _volatility(keep: float, start: float, per_year: int) -> Recurrence:
    """The state is the last value (NaN for none) and the square."""

    def squares(before, x):
        b = np.append(before, x[:-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = x / b
            change = np.where((ratio > 0) & np.isfinite(ratio), np.log(ratio), 0.0)
        return change * change

    def summary(x):
        a, b = affine_scan(np.full(len(x) - 1, keep), (1 - keep) * squares(x[0], x[1:])) if len(x) > 1 else (np.ones(1), np.zeros(1))
        return float(x[0]), float(x[-1]), float(a[-1]), float(b[-1])

    def after(state, m):
        square = start * start if state is None else keep * state[1] + (1 - keep) * float(squares(state[0], np.array([m[0]]))[0])
        return m[1], m[2] * square + m[3]

    def run(state, x):
        if state is None:
            a, b = affine_scan(np.full(len(x) - 1, keep), (1 - keep) * squares(x[0], x[1:])) if len(x) > 1 else (np.empty(0), np.empty(0))
            return np.append(0.0, np.sqrt((a * start * start + b) * per_year))
        a, b = affine_scan(np.full(len(x), keep), (1 - keep) * squares(state[0], x))
        return np.sqrt((a * state[1] + b) * per_year)

    return Recurrence(summary, after, run)


def volatility(df: DataFrame, path: str, session: str, value: str, keep: float = 0.94, start: float = 0.01, per_year: int = 252, size: int = ROWS) -> DataFrame:
    """path, session, value and vol: the yearly exponentially weighted volatility of log returns, from a daily one of `start`; the first
    session has 0. A return that is not there (NULL, or no positive ratio) counts as 0."""
    return along(df, path, session, value, _volatility(keep, start, per_year), "vol", size)


# --- a held value ---------------------------------------------------------------------


def _next_apart(x: np.ndarray, at: int, held: float, band: float) -> int:
    """The first place from `at` on whose value is more than the band from what is held; len(x) if there is none."""
    step = 16
    while at < len(x):
        away = np.flatnonzero(np.abs(x[at : at + step] - held) > band)
        if len(away):
            return at + int(away[0])
        at, step = at + step, 2 * step
    return len(x)


def _band(band: float) -> Recurrence:
    """The state is what is held. A chunk is told by the records of its running maximum and minimum: a state h leaves its band at the
    first value over h + band or under h - band, which is a record, and what follows depends on that record alone."""

    def trail(x, at, known):
        """What is held at the end, from x[at] held at `at` on."""
        seen = []
        while at not in known:
            seen.append(at)
            later = _next_apart(x, at + 1, x[at], band)
            if later == len(x):
                known[at] = float(x[at])
                break
            at = later
        for s in seen:
            known[s] = known[at]
        return known[at]

    def summary(x):
        x = x[~np.isnan(x)]
        if not len(x):
            return None
        known: dict[int, float] = {}
        high, low = np.maximum.accumulate(x), np.minimum.accumulate(x)
        wide = np.flatnonzero(high - low > 2 * band)  # every state has left its band by then
        upto = int(wide[0]) + 1 if len(wide) else len(x)
        up = np.flatnonzero(np.append(True, high[1:upto] > high[: upto - 1]))
        down = np.flatnonzero(np.append(True, low[1:upto] < low[: upto - 1]))
        return trail(x, 0, known), [(int(i), float(x[i]), trail(x, int(i), known)) for i in up], [(int(i), float(x[i]), trail(x, int(i), known)) for i in down]

    def after(state, m):
        if m is None:
            return state
        if state is None:
            return m[0]
        over = next(((i, end) for i, x, end in m[1] if abs(x - state) > band and x > state), None)
        under = next(((i, end) for i, x, end in m[2] if abs(x - state) > band and x < state), None)
        return min(x for x in (over, under) if x is not None)[1] if over or under else state

    def run(state, x):
        out = np.full(len(x), np.nan)
        there = np.flatnonzero(~np.isnan(x))
        at = 0
        if state is None:
            if not len(there):
                return out
            at = int(there[0])
            state = float(x[at])
        while at < len(x):
            later = _next_apart(x, at, state, band)
            out[at:later] = state
            if later < len(x):
                state = float(x[later])
            at = later
        return out

    return Recurrence(summary, after, run)


def banded(df: DataFrame, path: str, session: str, value: str, band: float, size: int = ROWS) -> DataFrame:
    """Hysteresis: `held` follows a value only when it moves from what is held by more than the band. NULL holds what there is."""
    return along(df, path, session, value, _band(band), "held", size)


# --- below the peak -------------------------------------------------------------------


def _below_peak() -> Recurrence:
    """1 - x / the largest value so far; the state is that value."""

    def peaks(state, x):
        return np.fmax.accumulate(np.append(np.nan if state is None else state, x))[1:]

    def summary(x):
        there = x[~np.isnan(x)]
        return float(there.max()) if len(there) else None

    def after(state, m):
        return m if state is None else state if m is None else max(state, m)

    def run(state, x):
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1 - x / peaks(state, x)
        return np.where(np.isinf(out), np.nan, out)

    return Recurrence(summary, after, run)


def drawdown(df: DataFrame, path: str, session: str, value: str, size: int = ROWS) -> DataFrame:
    """path, session, value and drawdown: 1 - value / the largest value so far; NULL where the value is, or the largest is 0."""
    return along(df, path, session, value, _below_peak(), "drawdown", size)


#: Recurrences by name, for streams.
RULES = {"ewma": lambda keep=0.94: _average(keep), "vol": lambda keep=0.94, start=0.01, per_year=252: _volatility(keep, start, per_year), "held": lambda band=1.0: _band(band), "drawdown": _below_peak}


# --- expanding median -----------------------------------------------------------------


def expanding_median(df: DataFrame, path: str, session: str, value: str, name: str = "median", size: int = ROWS) -> DataFrame:
    """path, session, value and the median of the path's values up to each row (the mean of the two in the middle). NULL and NaN count as no value; before the first one it is NULL.

    A chunk of m values moves the median of what came before by at most m ranks. Values are
    counted by chunk and by ranges of value; a chunk is sent the counts of the values in the
    ranges that hold those ranks, and how many lie below. A value that most rows have is one count.
    """
    kinds = dict((f.name, f.dataType) for f in df.schema.fields)
    rows = df.select(F.col(path).alias("p"), F.col(session).alias("s"), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("v"))
    n = ranges_for(rows, size)
    cut = chunked(rows, "p", "s", "chunk", size, n)
    cut = stored(chunked(cut, "p", "v", "range", max(1, size // 2), 2 * n), "chunks")
    counts = stored(cut.where("v IS NOT NULL").groupBy("p", "chunk", "range", "v").agg(F.count(F.lit(1)).alias("c")), "counts")
    by_range = counts.groupBy("p", "chunk", "range").agg(F.sum("c").alias("c"))
    # For each chunk the values before it, range by range: a path with k chunks has k times 2 k such counts.
    chunks = cut.groupBy("p", "chunk").agg(F.count("v").alias("m"))
    ranges = counts.select(F.col("p").alias("q"), F.col("range").alias("r")).distinct()
    same = F.col("p").eqNullSafe(F.col("q"))
    grid = chunks.join(ranges, same).select("p", "chunk", "m", F.col("r").alias("range"))
    own = by_range.select(F.col("p").alias("q"), F.col("chunk").alias("k"), F.col("range").alias("r"), "c")
    grid = grid.join(own, same & (F.col("chunk") == F.col("k")) & (F.col("range") == F.col("r")), "left").select("p", "chunk", "m", "range", F.coalesce("c", F.lit(0)).alias("c"))
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("p", "range").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = Window.partitionBy("p", "chunk")
    ranked = grid.withColumn("c", earlier).withColumns({"upto": F.sum("c").over(w.orderBy("range")), "total": F.sum("c").over(w)}).where("c > 0")
    low, high = F.floor((F.col("total") - 1) / 2) - F.col("m") - 1, F.floor(F.col("total") / 2) + F.col("m") + 1
    needed = stored(ranked.where((F.col("upto") > low) & (F.col("upto") - F.col("c") <= high)).select("p", "chunk", "range", (F.col("upto") - F.col("c")).alias("under"), "total"), "needed")
    told = counts.select(F.col("p").alias("q"), F.col("chunk").alias("before"), F.col("range").alias("r"), "v", "c")
    near = needed.join(told, same & (F.col("range") == F.col("r")) & (F.col("before") < F.col("chunk"))).groupBy("p", "chunk", "v").agg(F.sum("c").alias("c"), F.min("under").alias("under"), F.max("total").alias("total"))
    # Counts come first in a chunk, then its rows.
    every = near.select("p", "chunk", F.lit(0).alias("kind"), F.lit(None).cast(kinds[session]).alias("s"), "v", "c", "under", "total")
    every = every.unionByName(cut.select("p", "chunk", F.lit(1).alias("kind"), "s", "v", F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("under"), F.lit(None).cast("long").alias("total")))
    dealt = every.repartition("p", "chunk").sortWithinPartitions("p", "chunk", "kind", "s")
    schema = T.StructType([T.StructField(path, kinds[path]), T.StructField(session, kinds[session]), T.StructField(value, T.DoubleType()), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments(batches, 2):
            own = part.column(2).to_numpy() == 1
            v = part.column(4).to_numpy(zero_copy_only=False).astype(float)
            if not own.any():
                continue
            c = part.column(5).to_numpy(zero_copy_only=False)[~own].astype(np.int64)
            under = int(min(part.column(6).filter(pa.array(~own)).to_pylist(), default=0))
            total = int(max(part.column(7).filter(pa.array(~own)).to_pylist(), default=0))
            out = medians(v[own], v[~own], c, under, total)
            rows_ = part.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([rows_.column(0), rows_.column(3), rows_.column(4), pa.array(out, pa.float64(), from_pandas=True)], names=[path, session, value, name])

    return dealt.mapInArrow(run, schema)


def medians(x: np.ndarray, values: np.ndarray, counts: np.ndarray, under: int, total: int) -> np.ndarray:
    """The median after each of x (NaN: no value), after `total` values before, of which `under` lie below all `values`, which come with their counts."""
    there = ~np.isnan(x)
    every = np.unique(np.concatenate([values, x[there]]))
    if not len(every):
        return np.full(len(x), np.nan)
    count = np.zeros(len(every), np.int64)
    np.add.at(count, np.searchsorted(every, values), counts)
    place, count = np.searchsorted(every, x).tolist(), count.tolist()
    spot, below, out, names = 0, under, [], every.tolist()  # below: values under names[spot]
    for good, j in zip(there.tolist(), place):
        if good:
            count[j] += 1
            total += 1
            below += j < spot
        if not total:
            out.append(math.nan)
            continue
        rank = (total - 1) // 2
        while rank < below:
            spot -= 1
            below -= count[spot]
        while rank >= below + count[spot]:
            below += count[spot]
            spot += 1
        next_ = spot
        if total % 2 == 0 and rank + 1 >= below + count[spot]:
            next_ += 1
            while not count[next_]:
                next_ += 1
        out.append((names[spot] + names[next_]) / 2)
    return np.array(out)


def vol_ratio(df: DataFrame, path: str, session: str, value: str, keep: float = 0.94, start: float = 0.01, per_year: int = 252, size: int = ROWS) -> DataFrame:
    """path, session, value, vol, its expanding median and their ratio (1 where the median is 0)."""
    vol = stored(volatility(df, path, session, value, keep, start, per_year, size), "vol")
    median = expanding_median(vol, path, session, "vol", "vol_median", size)
    both = median.join(vol.select(F.col(path).alias("__p"), F.col(session).alias("__s"), F.col(value)), F.col(path).eqNullSafe(F.col("__p")) & F.col(session).eqNullSafe(F.col("__s")))
    return both.select(path, session, value, "vol", "vol_median", F.when(F.col("vol_median") == 0, 1.0).otherwise(F.try_divide("vol", "vol_median")).alias("vol_ratio"))
