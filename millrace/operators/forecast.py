"""Out-of-sample factor forecasts from running moments: a panel (a key's rows in order) is streamed, and never held."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.recurrences import ROWS, chunked, ranges_for, segments
from millrace.operators.regression import deviations
from millrace.sources.shared import stored


class Moments:
    """Count, sums and sums of products of rows, less a fixed row near them, so that large means cost few digits."""

    def __init__(self, width: int):
        self.n, self.s, self.p = 0, np.zeros(width), np.zeros((width, width))

    def add(self, row: np.ndarray, sign: int = 1) -> None:
        self.n += sign
        self.s += sign * row
        self.p += sign * np.outer(row, row)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        return self.s / self.n, self.p - np.outer(self.s, self.s) / self.n


def fit(m: Moments, k: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of the three-pass filter, from moments of rows y, k columns x, proxies."""
    mean, c = m.centred()
    x, z = slice(1, 1 + k), slice(1 + k, None)
    d = deviations(np.diag(c)[x], mean[x], m.n)
    w = c[x, z] / d[:, None]
    w = w - w.mean(0)
    alpha = w @ np.linalg.lstsq(w.T @ (c[x, x] / np.outer(d, d)) @ w, w.T @ (c[x, 0] / d), rcond=1e-12)[0] / d
    return float(mean[0] - alpha @ mean[x]), alpha


def out_of_sample(df: DataFrame, key: str, order: str, y: str, xs: list[str], zs: list[str] | None = None, *, procedure: str = "recursive", train: int = 20, window: int = 0, size: int = ROWS) -> DataFrame:
    """key, order, y, forecast (NaN where nothing precedes) and mean_forecast (of the mean of the rows that were learnt from).

    recursive: each row from all rows before it, from row `train` on. rolling: from the
    `train` rows before it. cross: each row from all rows but those within `window` of it.
    zs None: y itself is the proxy. Rows with a NaN or NULL in any column teach nothing.

    recursive and rolling: a key's rows are cut into chunks of about `size` rows (where the
    order is a number, date or timestamp); each chunk's moments or last rows are carried to
    those after it, and chunks run side by side. cross: rows are dealt out by key and sorted;
    a first stream gives each key's moments, a row for each key, and a second one streams
    through the rows with the last 2 * window of them.
    """
    if procedure not in ("recursive", "rolling", "cross"):
        raise ValueError(procedure)
    if procedure != "cross":
        return _carried(df, key, order, y, xs, zs, procedure == "rolling", train, size)
    used, k = [y, *xs, *(zs or [])], len(xs)
    width = 1 + k + (len(zs) if zs else 1)
    nan = F.lit(float("nan"))
    rows = df.select(F.col(key).alias("__key"), F.col(order).alias("__order"), *[F.coalesce(F.col(c).cast("double"), nan).alias(f"__{i}") for i, c in enumerate(used)])
    dealt = rows.repartition("__key").sortWithinPartitions("__key", "__order")
    names, kinds = [f"__{i}" for i in range(len(used))], dict(df.dtypes)

    def arrays(batch: pa.RecordBatch) -> tuple[list, list, np.ndarray]:
        return batch.column(0).to_pylist(), batch.column(1), np.column_stack([np.asarray(batch.column(2 + i)) for i in range(len(used))]) if batch.num_rows else np.empty((0, len(used)))

    def learnt(row: np.ndarray, base: np.ndarray) -> np.ndarray | None:
        full = np.append(row, row[:1]) if not zs else row
        return None if np.isnan(full).any() else full - base

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, m, base, begun = None, None, None, False

        def out():
            kind = pa.list_(pa.float64())
            cols = [pa.array([current]), pa.array([base.tolist()], kind), pa.array([[float(m.n), *m.s, *m.p.ravel()]], kind)]
            return pa.RecordBatch.from_arrays([cols[0].cast(key_type), *cols[1:]], names=["__key", "__base", "__moments"])

        for batch in batches:
            keys, _, data = arrays(batch)
            key_type = batch.schema.field(0).type
            for name, row in zip(keys, data):
                if not begun or name != current:
                    if begun:
                        yield out()
                    current, m, begun = name, Moments(width), True
                    base = np.nan_to_num(np.append(row, row[:1]) if not zs else row)
                if (v := learnt(row, base)) is not None:
                    m.add(v)
        if begun:
            yield out()

    sums = dealt.mapInArrow(total, f"__key {kinds[key]}, __base array<double>, __moments array<double>")
    dealt = rows.join(sums, rows["__key"].eqNullSafe(sums["__key"])).drop(sums["__key"]).repartition("__key").sortWithinPartitions("__key", "__order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun = None, False
        m = base = near = None  # what was learnt; the row taken from all; rows near by, ahead ones included
        waiting: deque = deque()  # rows of cross whose later neighbours are not all there yet

        def say(row):
            if m.n < 3 or np.isnan(row[1 : 1 + k]).any():
                return float("nan"), float("nan")
            a, b = fit(m, k)
            return base[0] + a + float(b @ (row[1 : 1 + k] - base[1 : 1 + k])), base[0] + m.s[0] / m.n

        def settle():
            """The forecast of the first waiting row: all rows less those within the window of it."""
            name, at, row = waiting.popleft()
            out = name, at, row, say(row)
            near.append(row)
            if len(near) > window:  # it is out of the next row's window
                v = learnt(near.popleft(), base)
                if v is not None:
                    m.add(v)
            return out

        def batch_of(found, schema):
            cols = list(zip(*[(n, o, r[0], *s) for n, o, r, s in found])) if found else [[]] * 5
            types = [schema.field(0).type, schema.field(1).type, *[pa.float64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["__key", "__order", "__y", "forecast", "mean_forecast"])

        schema = None
        for batch in batches:
            schema, found = batch.schema, []
            keys, orders, data = arrays(batch)
            more = [batch.column(2 + len(used) + i) for i in range(2)]
            for j, (name, at, row) in enumerate(zip(keys, orders.to_pylist(), data)):
                if not begun or name != current:
                    while waiting:
                        found.append(settle())
                    current, begun, near, m = name, True, deque(), Moments(width)
                    base, v = np.array(more[0][j].as_py()), np.array(more[1][j].as_py())
                    m.n, m.s, m.p = int(v[0]), v[1 : 1 + width].copy(), v[1 + width :].reshape(width, width).copy()
                v = learnt(row, base)
                waiting.append((name, at, row))
                if v is not None:
                    m.add(v, -1)
                if len(waiting) > window:
                    found.append(settle())
            yield batch_of(found, schema)
        if waiting:
            found = []
            while waiting:
                found.append(settle())
            yield batch_of(found, schema)

    held = ["__key", "__order", *names, "__base", "__moments"]
    found = dealt.select(*held).mapInArrow(run, f"__key {kinds[key]}, __order {kinds[order]}, __y double, forecast double, mean_forecast double")
    return found.select(F.col("__key").alias(key), F.col("__order").alias(order), F.col("__y").alias(y), "forecast", "mean_forecast")


def _carried(df: DataFrame, key: str, order: str, y: str, xs: list[str], zs: list[str] | None, rolling: bool, train: int, size: int) -> DataFrame:
    """Recursive and rolling forecasts, chunk by chunk."""
    used, k, kinds = [y, *xs, *(zs or [])], len(xs), {f.name: f.dataType for f in df.schema.fields}
    nan = F.lit(float("nan"))
    rows = df.select(F.col(key).alias("__key"), F.col(order).alias("__order"), *[F.coalesce(F.col(c).cast("double"), nan).alias(f"__{i}") for i, c in enumerate(used)])
    numbers = isinstance(kinds[order], (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    cut = stored(chunked(rows, "__key", "__order", "__chunk", size, ranges_for(rows, size)) if numbers else rows.withColumn("__chunk", F.lit(0)), "panel")
    places = ["__key", "__chunk", "__order", *[f"__{i}" for i in range(len(used))]]
    names = [T.StructField("__key", kinds[key]), T.StructField("__chunk", T.IntegerType())]

    def full(part: pa.RecordBatch, first: int) -> np.ndarray:
        """Rows of y, the columns and the proxies."""
        data = np.column_stack([np.asarray(c) for c in part.columns[first : first + len(used)]])
        return data if zs else np.column_stack([data, data[:, 0]])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments(batches, 2):
            data = full(part, 3)
            if rolling:
                told = data[-train:]
            else:
                base = np.nan_to_num(data[0])
                near = data[~np.isnan(data).any(1)] - base
                told = base, len(near), near.sum(0), near.T @ near
            yield pa.RecordBatch.from_arrays([part.column(0)[:1], part.column(1)[:1], pa.array([pickle.dumps(told)], pa.binary())], names=["__key", "__chunk", "m"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, None, False
        for batch in batches:
            out = []
            for name, m in zip(batch.column(0).to_pylist(), map(pickle.loads, batch.column(2).to_pylist())):
                if not begun or name != current:
                    current, state, begun = name, None, True
                out.append(None if state is None else pickle.dumps(state))
                if state is None:
                    state = m
                elif rolling:
                    state = np.concatenate([state, m])[-train:]
                else:  # moments about another row are moved to the first one
                    d = m[0] - state[0]
                    state = state[0], state[1] + m[1], state[2] + m[2] + m[1] * d, state[3] + m[3] + np.outer(m[2], d) + np.outer(d, m[2]) + m[1] * np.outer(d, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["__key", "__chunk", "state"])

    dealt = cut.select(places).repartition("__key", "__chunk").sortWithinPartitions("__key", "__chunk", "__order")
    maps = dealt.mapInArrow(sum_up, T.StructType([*names, T.StructField("m", T.BinaryType())]))
    states = stored(maps.repartition("__key").sortWithinPartitions("__key", "__chunk").mapInArrow(carry, T.StructType([*names, T.StructField("state", T.BinaryType())])), "moments")  # a row for each chunk of a key
    both = cut.join(states, cut["__key"].eqNullSafe(states["__key"]) & (cut["__chunk"] == states["__chunk"])).select(*[cut[c] for c in places], "state")
    both = both.repartition("__key", "__chunk").sortWithinPartitions("__key", "__chunk", "__order")
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(order, kinds[order]), *(T.StructField(c, T.DoubleType()) for c in (y, "forecast", "mean_forecast"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments(batches, 2):
            data, state = full(part, 3), part.column(3 + len(used))[0].as_py()
            state = None if state is None else pickle.loads(state)
            m, near = Moments(data.shape[1]), deque()
            base = np.nan_to_num(data[0]) if state is None or rolling else state[0]
            learnt = lambda row: None if np.isnan(row).any() else row - base  # noqa: B023, E731
            if state is not None and rolling:
                near.extend(map(learnt, state))
                for v in near:
                    if v is not None:
                        m.add(v)
            elif state is not None:
                m.n, m.s, m.p = state[1], state[2].copy(), state[3].copy()
            out = np.full((len(data), 2), np.nan)
            for j, row in enumerate(data):
                if m.n >= max(train, 3) and not np.isnan(row[1 : 1 + k]).any():
                    a, b = fit(m, k)
                    out[j] = base[0] + a + float(b @ (row[1 : 1 + k] - base[1 : 1 + k])), base[0] + m.s[0] / m.n
                v = learnt(row)
                if rolling:
                    near.append(v)
                    if len(near) > train and (old := near.popleft()) is not None:
                        m.add(old, -1)
                if v is not None:
                    m.add(v)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(out[:, 0]), pa.array(out[:, 1])], names=schema.names)

    return both.mapInArrow(run, schema)


def forecast_quality(df: DataFrame, key: str, y: str) -> DataFrame:
    """For each panel: n, out-of-sample R2 against the mean forecast, and the encompassing statistic."""
    both = df.where(~F.isnan("forecast"))
    a, b = F.col(y) - F.col("mean_forecast"), F.col(y) - F.col("forecast")
    found = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(b * b).alias("bb"), F.sum(a * a).alias("aa"), F.sum(a * a - a * b).alias("gain"))
    return found.select(key, "n", (1 - F.try_divide("bb", "aa")).alias("r_squared"), (F.col("n") * F.try_divide("gain", "bb")).alias("encnew"))
