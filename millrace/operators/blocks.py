"""Large dense matrices in square blocks (bi, bj, block): products, elimination, Cholesky and leading eigenpairs.

A block is a row of bytes. Work on a block is done where it is dealt to by its place: what it
needs of other blocks is sent there and streams by, so that a task holds a block, its result
and one pair of factors. Elimination picks its pivots inside a block column by a tournament:
each block proposes its best rows, which meet FAN at a time. Small factors are worked on in
tasks too: there Spark gives BLAS one thread, while its threads can stall in a driver that has forked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import tall
from millrace.sources.shared import dropped, stored

#: Rows and columns of a block (512 KB).
SIZE = 256
#: Blocks along the inner side that one sum of a product takes.
DEPTH = 64
#: Blocks are joined up to this size for an elimination; blocks of a tile's side in it; columns that are searched for pivots one by one.
PANEL, TILE, NARROW = 512, 4, 32
#: Joined blocks and tiles are at least so many along a side, where there are as many blocks.
SPREAD = 8
#: Rows that are proposed by so many blocks meet in one task.
FAN = 8
#: Rows of a matrix that is eliminated at most: the driver keeps the number of each.
MOST = 1 << 20
BLOCKS = "bi int, bj int, block binary"


@dataclass(frozen=True)
class Grid:
    """The shape of a matrix in blocks; what tasks are told of it."""

    rows: int
    columns: int
    size: int

    @property
    def down(self) -> int:
        return -(-self.rows // self.size)

    @property
    def across(self) -> int:
        return -(-self.columns // self.size)

    def shape(self, bi: int, bj: int) -> tuple[int, int]:
        return min(self.size, self.rows - bi * self.size), min(self.size, self.columns - bj * self.size)


@dataclass
class Blocked:
    df: DataFrame  # bi, bj, block; blocks that are not there are zero
    grid: Grid

    rows = property(lambda self: self.grid.rows)
    columns = property(lambda self: self.grid.columns)
    size = property(lambda self: self.grid.size)


def _batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    bi, bj, blocks = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(bi, pa.int32()), pa.array(bj, pa.int32()), pa.array([np.ascontiguousarray(b, float).tobytes() for b in blocks], pa.binary())], names=["bi", "bj", "block"])


def _streamed(rows: DataFrame, keys: list[str], then: list[str], schema: str, begin, take, end) -> DataFrame:
    """Rows dealt out by keys and sorted; for each key a state from begin(key), take(state, row) for each row, and end(state), an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[: len(keys)] != key:
                    if key is not None:
                        out.append((*key[:2], end(state)))
                    key = row[: len(keys)]
                    state = begin(key)
                state = take(state, row[len(keys) :])
            if out:
                yield _batch(out)
        if key is not None:
            yield _batch([(*key[:2], end(state))])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *then).mapInArrow(run, schema)


def from_cells(cells: DataFrame, rows: int, columns: int, size: int = SIZE) -> Blocked:
    """Of cells (i, j, v); equal places are added up, and cells that are not there are 0."""
    grid = Grid(rows, columns, size)
    parts = cells.select(F.floor(F.col("i") / size).cast("int").alias("bi"), F.floor(F.col("j") / size).cast("int").alias("bj"), (F.col("i") % size).cast("int").alias("r"), (F.col("j") % size).cast("int").alias("c"), F.col("v").cast("double").alias("v"))

    def put(block, row):
        block[row[0], row[1]] += np.nan if row[2] is None else row[2]
        return block

    return Blocked(_streamed(parts, ["bi", "bj"], [], BLOCKS, lambda key: np.zeros(grid.shape(*key)), put, lambda b: b), grid)


def from_rows(df: DataFrame, index: str, row: str, rows: int, columns: int, size: int = SIZE) -> Blocked:
    """Of row vectors with a dense index from 0; each is cut into slices where it stands."""
    grid = Grid(rows, columns, size)
    sliced = df.select(F.floor(F.col(index) / size).cast("int").alias("bi"), (F.col(index) % size).cast("int").alias("r"), F.col(row).cast("array<double>").alias("v")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.lit(grid.across - 1))))
    sliced = sliced.select("bi", "bj", "r", F.slice("v", F.col("bj") * size + 1, size).alias("v"))

    def put(block, r):
        block[r[0]] = r[1]
        return block

    return Blocked(_streamed(sliced, ["bi", "bj"], [], BLOCKS, lambda key: np.zeros(grid.shape(*key)), put, lambda b: b), grid)


def identity(spark, n: int, size: int = SIZE) -> Blocked:
    grid = Grid(n, n, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield _batch([(k, k, np.eye(grid.shape(k, k)[0]))])

    return Blocked(spark.range(grid.down).mapInArrow(run, BLOCKS), grid)


def cells(m: Blocked) -> DataFrame:
    """(i, j, v) of every cell of the blocks that are there."""
    grid, size = m.grid, m.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                r, c = grid.shape(bi, bj)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(r) + bi * size, c)), pa.array(np.tile(np.arange(c) + bj * size, r)), pa.array(np.frombuffer(raw))], names=["i", "j", "v"])

    return m.df.mapInArrow(run, "i long, j long, v double")


def transposed(m: Blocked) -> Blocked:
    grid = m.grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                yield _batch([(bj, bi, np.frombuffer(raw).reshape(grid.shape(bi, bj)).T)])

    return Blocked(m.df.mapInArrow(run, BLOCKS), Grid(m.columns, m.rows, m.size))


def _copies(df: DataFrame, column: str, n: int, low: int = 0) -> DataFrame:
    """A row for each place from low to n - 1."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(low), F.lit(n - 1)))) if n > low else df.withColumn(column, F.lit(0)).limit(0)


def matmul(a: Blocked, b: Blocked) -> Blocked:
    """a b. Blocks are sent to every block of the result that they are part of, DEPTH of each along the inner side to one sum; partial sums are added up.

    A result of few blocks with a long inner side (X'X of a tall X) thereby is many tasks too.
    """
    if a.columns != b.rows or a.size != b.size:
        raise ValueError("shapes don't match")
    of_a, of_b, out = a.grid, b.grid, Grid(a.rows, b.columns, a.size)
    group = F.floor(F.col("k") / DEPTH).alias("g")
    left = _copies(a.df.select("bi", F.col("bj").alias("k"), F.lit(0).alias("side"), "block"), "bj", out.across).select("bi", "bj", group, "k", "side", "block")
    right = _copies(b.df.select(F.col("bi").alias("k"), "bj", F.lit(1).alias("side"), "block"), "bi", out.down).select("bi", "bj", group, "k", "side", "block")

    def take(state, row):
        (bi, bj), total, hold = state
        k, side, raw = row
        if side == 0:
            return (bi, bj), total, (k, np.frombuffer(raw).reshape(of_a.shape(bi, k)))
        if hold is not None and hold[0] == k:
            total += hold[1] @ np.frombuffer(raw).reshape(of_b.shape(k, bj))
        return (bi, bj), total, None

    sums = _streamed(left.unionByName(right), ["bi", "bj", "g"], ["k", "side"], BLOCKS, lambda key: (key[:2], np.zeros(out.shape(*key[:2])), None), take, lambda s: s[1])
    return Blocked(sums if of_a.across <= DEPTH else _added(sums, out), out)


def _added(parts: DataFrame, grid: Grid) -> DataFrame:
    def take(total, row):
        total += np.frombuffer(row[0]).reshape(total.shape)
        return total

    return _streamed(parts, ["bi", "bj"], [], BLOCKS, lambda key: np.zeros(grid.shape(*key)), take, lambda t: t)


def plus(a: Blocked, b: Blocked, by: float = 1.0) -> Blocked:
    """a + by * b."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                yield _batch([(bi, bj, by * np.frombuffer(raw))])

    return Blocked(_added(a.df.unionByName(b.df.mapInArrow(run, BLOCKS)), a.grid), a.grid)


def kept(m: Blocked, name: str = "blocks") -> Blocked:
    return Blocked(stored(m.df, name), m.grid)


# --- elimination ----------------------------------------------------------------------


def resized(m: Blocked, size: int) -> Blocked:
    """The same matrix in blocks of another size, a multiple of its own or a part of it."""
    if size == m.size:
        return m
    if size % m.size and m.size % size:
        raise ValueError("one size has to divide the other")
    grid, out, part = m.grid, Grid(m.rows, m.columns, size), min(size, m.size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                x = np.frombuffer(raw).reshape(grid.shape(bi, bj))
                rows = []
                for r in range(0, len(x), part):
                    for c in range(0, x.shape[1], part):
                        i, j = bi * grid.size + r, bj * grid.size + c
                        rows.append((i // size, j // size, i % size, j % size, np.ascontiguousarray(x[r : r + part, c : c + part]).tobytes(), min(part, x.shape[1] - c)))
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in list(zip(*rows))[:4]), pa.array([v[4] for v in rows], pa.binary()), pa.array([v[5] for v in rows], pa.int32())], names=["bi", "bj", "r", "c", "block", "w"])

    def put(block, row):
        r, c, raw, w = row
        x = np.frombuffer(raw).reshape(-1, w)
        block[r : r + len(x), c : c + w] = x
        return block

    parts = m.df.mapInArrow(cut, "bi int, bj int, r int, c int, block binary, w int")
    return Blocked(_streamed(parts, ["bi", "bj"], [], BLOCKS, lambda key: np.zeros(out.shape(*key)), put, lambda b: b), out)


def _best_rows(values: np.ndarray, b: int) -> np.ndarray:
    """Places of the b rows that elimination with row exchanges would take, in its order; NARROW columns at once, then a product for the others."""
    left, order = values.copy(), np.arange(len(values))
    top = min(b, len(left))
    for s in range(0, top, NARROW):
        e = min(s + NARROW, top)
        for k in range(s, e):
            p = k + int(np.abs(left[k:, k]).argmax())
            left[[k, p]], order[[k, p]] = left[[p, k]], order[[p, k]]
            if left[k, k]:
                left[k + 1 :, k] /= left[k, k]
                left[k + 1 :, k + 1 : e] -= np.outer(left[k + 1 :, k], left[k, k + 1 : e])
        if e < left.shape[1]:
            left[s:e, e:] = np.linalg.solve(np.tril(left[s:e, s:e], -1) + np.eye(e - s), left[s:e, e:])
            left[e:, e:] -= left[e:, s:e] @ left[s:e, e:]
    return order[:b]


def _pivots(column: DataFrame, m: Grid, j: int, b: int, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, float, float]:
    """Numbers of the b rows on which elimination goes on, of those of block column j that are not taken; the inverse of their
    part of the column, and its determinant (sign and logarithm). All of it is done in tasks."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, raw in zip(*[c.to_pylist() for c in batch.columns]):
                free = np.flatnonzero(~taken[bi * m.size : bi * m.size + m.shape(bi, j)[0]])
                x = np.frombuffer(raw).reshape(m.shape(bi, j))[free]
                at = _best_rows(x, b)
                yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([free[at] + bi * m.size, x[at]]).tobytes()], pa.binary())], names=["m"])

    def meet(held: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(held)
        x = x[np.argsort(x[:, 0])]  # whatever order the blocks come in
        return x[_best_rows(x[:, 1:], b)]

    def met(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held = [np.empty((0, b + 1))]
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw).reshape(-1, b + 1))
                if len(held) == FAN:
                    held = [meet(held)]
        return meet(held)

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([met(batches).tobytes()], pa.binary())], names=["m"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = met(batches)
        sign, log = np.linalg.slogdet(x[:, 1:]) if len(x) == b else (0.0, -np.inf)
        inverse = None if sign == 0 or np.isnan(log) else np.linalg.inv(x[:, 1:]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x[:, 0].astype("<i8").tobytes()], pa.binary()), pa.array([inverse], pa.binary()), pa.array([float(sign)]), pa.array([float(log)])], names=["at", "inverse", "sign", "log"])

    table = stored(column.select("bi", "block").mapInArrow(propose, "m binary"), "parts")
    n = table.count()
    while n > FAN:
        before, n = table, -(-n // FAN)
        table = stored(table.repartition(n).mapInArrow(rounds, "m binary"), "parts")
        dropped(before)
    found = table.repartition(1).mapInArrow(last, "at binary, inverse binary, sign double, log double").first()  # one small block
    dropped(table)
    if found is None:
        return np.empty(0, np.int64), None, 0.0, -np.inf
    return np.frombuffer(found["at"], "<i8"), None if found["inverse"] is None else np.frombuffer(found["inverse"]).reshape(b, b), found["sign"], found["log"]


def eliminate(a: Blocked, b: Blocked | None = None) -> tuple[Blocked | None, float, float]:
    """a^-1 b (None: no right side), and the sign and the logarithm of the absolute determinant, by Gauss-Jordan elimination in block columns.

    Each step takes the pivots of one block column, which stay where they are, and clears the
    column in all other rows; columns that are done are not carried on, and rows are put in
    order at the end. Many small blocks are joined to blocks of up to PANEL for it. A singular
    matrix has determinant 0 and no solution (LinAlgError with a right side). a has at most
    MOST rows; a task holds the blocks that a tile of the result is cleared with, 2 TILE at
    most, and two more.
    """
    n, own_size = a.rows, a.size
    if n != a.columns or n > MOST or (b is not None and (b.rows != n or b.size != own_size)):
        raise ValueError("a square matrix, and a right side of as many rows, are needed")
    size = own_size * max(1, min(PANEL // own_size, a.grid.down // SPREAD))
    a, b = resized(a, size), None if b is None else resized(b, size)
    of_a, of_b = a.grid, b.grid if b is not None else None
    shift = of_a.across
    width = shift + (of_b.across if b is not None else 0)
    both = a.df if b is None else a.df.unionByName(b.df.withColumn("bj", F.col("bj") + shift))
    shape = lambda bi, bj: of_a.shape(bi, bj) if bj < shift else of_b.shape(bi, bj - shift)
    now, sign, size_log = stored(both, "elimination"), 1.0, 0.0
    to, taken = np.full(n, -1, np.int64), np.zeros(n, bool)  # the place of a row's unknown
    for j in range(shift):
        own = of_a.shape(j, j)[0]
        rows, inverse, s, log = _pivots(now.where(F.col("bj") == j), of_a, j, own, taken)
        if inverse is None:
            dropped(now)
            if b is not None:
                raise np.linalg.LinAlgError("the matrix is singular")
            return None, float("nan") if np.isnan(log) else 0.0, float(log)
        to[rows], taken[rows] = np.arange(j * size, j * size + own), True
        sign, size_log = sign * s, size_log + log
        if j + 1 == width:
            break
        top = stored(_pivot_rows(now.where(F.col("bj") > j), rows, inverse, size, shape), "pivots")
        before, now = now, stored(_cleared(now, top, rows, j, of_a.down, width, size, shape), "elimination")
        dropped(before, top)
    sign *= _parity(to)
    if b is None:
        dropped(now)
        return None, sign, size_log
    out = stored(_ordered(now.withColumn("bj", F.col("bj") - shift), to, of_b), "solution")
    dropped(now)
    return resized(Blocked(out, of_b), own_size), sign, size_log


def _parity(to: np.ndarray) -> float:
    seen, sign, to = set(), 1.0, to.tolist()
    for k in range(len(to)):
        length = 0
        while k not in seen:
            seen.add(k)
            k, length = to[k], length + 1
        sign *= -1.0 if length and length % 2 == 0 else 1.0
    return sign


def _sent(blocks: DataFrame, number, shape) -> DataFrame:
    """(bi, bj, at, block): the rows of blocks by the block they go to, by what number(bi, rows) says of blocks and places in them, -1 for rows that go nowhere."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                x = np.frombuffer(raw).reshape(shape(bi, bj))
                block, at = number(bi, len(x))
                goes = [(k, np.flatnonzero(block == k)) for k in np.unique(block[block >= 0]).tolist()]
                if goes:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k for k, _ in goes], pa.int32()), pa.array([bj] * len(goes), pa.int32()),
                        pa.array([at[r].astype("<i4").tobytes() for _, r in goes], pa.binary()), pa.array([x[r].tobytes() for _, r in goes], pa.binary()),
                    ], names=["bi", "bj", "at", "block"])

    return blocks.mapInArrow(cut, "bi int, bj int, at binary, block binary")


def _filled(block, row):
    at = np.frombuffer(row[0], "<i4")
    block[at] = np.frombuffer(row[1]).reshape(len(at), -1)
    return block


def _pivot_rows(rest: DataFrame, rows: np.ndarray, inverse: np.ndarray, size: int, shape) -> DataFrame:
    """The pivots' rows of the block columns that are left, times the inverse: a block (0, bj) for each."""
    order = np.argsort(rows)
    found = rows[order]

    def number(bi, n):
        low, high = np.searchsorted(found, [bi * size, bi * size + n])
        block, at = np.full(n, -1), np.zeros(n, np.int64)
        block[found[low:high] - bi * size], at[found[low:high] - bi * size] = 0, order[low:high]
        return block, at

    return _streamed(_sent(rest, number, shape), ["bi", "bj"], [], BLOCKS, lambda key: np.zeros((len(rows), shape(*key)[1])), _filled, lambda x: inverse @ x)


def _ordered(df: DataFrame, to: np.ndarray, grid: Grid) -> DataFrame:
    """Blocks after row r has moved to place to[r]."""

    def number(bi, n):
        t = to[bi * grid.size : bi * grid.size + n]
        return t // grid.size, t % grid.size

    return _streamed(_sent(df, number, grid.shape), ["bi", "bj"], [], BLOCKS, lambda key: np.zeros(grid.shape(*key)), _filled, lambda x: x)


def _cleared(now: DataFrame, top: DataFrame, rows: np.ndarray, j: int, down: int, width: int, size: int, shape) -> DataFrame:
    """Block columns after j, cleared: the pivots' rows become those of top, the others lose their part of column j times top.

    Blocks meet in tiles of the result, so that what they are cleared with is sent to each tile once.
    """
    t = max(1, min(TILE, down // SPREAD))
    tile = lambda c: F.floor(F.col(c) / t).cast("int")
    base = now.where(F.col("bj") > j).select(tile("bi").alias("ti"), tile("bj").alias("tj"), F.lit(2).alias("side"), "bi", "bj", "block")
    column = _copies(now.where(F.col("bj") == j).select(tile("bi").alias("ti"), F.lit(0).alias("side"), "bi", "bj", "block"), "tj", (width - 1) // t + 1, (j + 1) // t)
    row = _copies(top.select(tile("bj").alias("tj"), F.lit(1).alias("side"), "bi", "bj", "block"), "ti", (down - 1) // t + 1)
    order = np.argsort(rows)
    found = rows[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, upper, seen = None, {}, {}, set()

        def result(bi, bj, x):
            low, high = np.searchsorted(found, [bi * size, bi * size + len(left[bi])])
            out = left[bi] @ upper[bj]
            out = -out if x is None else x - out
            out[found[low:high] - bi * size] = upper[bj][order[low:high]]
            return out

        def missing():
            for bi in left:
                for bj in upper:
                    if (bi, bj) not in seen:
                        yield _batch([(bi, bj, result(bi, bj, None))])

        for batch in batches:
            for k in range(batch.num_rows):
                ti, tj, side, bi, bj, raw = [c[k].as_py() for c in batch.columns]
                if key != (ti, tj):
                    yield from missing()
                    key, left, upper, seen = (ti, tj), {}, {}, set()
                x = np.frombuffer(raw).reshape(-1, shape(bi, bj)[1])
                if side == 0:
                    left[bi] = x
                elif side == 1:
                    upper[bj] = x
                else:
                    seen.add((bi, bj))
                    yield _batch([(bi, bj, result(bi, bj, x) if bi in left and bj in upper else x)])
        yield from missing()

    columns = ["ti", "tj", "side", "bi", "bj", "block"]
    parts = base.unionByName(column.select(columns)).unionByName(row.select(columns))
    return parts.repartition("ti", "tj").sortWithinPartitions("ti", "tj", "side").mapInArrow(run, BLOCKS)


def solve(a: Blocked, b: Blocked) -> Blocked:
    return eliminate(a, b)[0]


def solve_updated(u: Blocked, v: Blocked, b: Blocked) -> Blocked:
    """The solution x of (I + u v') x = b, for tall u and v; their square product, n^2 numbers of n rows, is not made.

    x = b - u s for the solution s of (I + v' u) s = v' b, a system of as many equations as u has columns,
    which is singular where the large one is (LinAlgError). As b - u s cancels where u v' is
    large, the same is done once more for what x leaves of b.
    """
    if (u.rows, u.columns, u.size) != (v.rows, v.columns, v.size) or b.rows != u.rows or b.size != u.size:
        raise ValueError("shapes don't match")
    turned = transposed(v)
    small = kept(plus(matmul(turned, u), identity(u.df.sparkSession, u.columns, u.size)), "small")

    def once(right: Blocked) -> Blocked:
        return kept(plus(right, matmul(u, solve(small, kept(matmul(turned, right), "small"))), -1.0), "solution")

    first = once(b)
    left = kept(plus(b, updated(u, v, first), -1.0), "left")
    more = once(left)
    x = kept(plus(first, more), "solution")
    dropped(small.df, first.df, left.df, more.df)
    return x


def updated(u: Blocked, v: Blocked, x: Blocked) -> Blocked:
    """(I + u v') x, by way of v' x."""
    return plus(x, matmul(u, kept(matmul(transposed(v), x), "small")))


def inverse(a: Blocked) -> Blocked:
    return eliminate(a, identity(a.df.sparkSession, a.rows, a.size))[0]


def determinant(a: Blocked) -> tuple[float, float]:
    """Its sign (0: singular) and the logarithm of its absolute value."""
    return eliminate(a)[1:]


def cholesky(a: Blocked) -> Blocked:
    """The lower L of a symmetric positive definite a = L L' (its lower half is read); else LinAlgError."""
    grid = a.grid
    n = grid.down
    now, done = stored(a.df.where("bi >= bj"), "left"), []
    for j in range(n):
        def factor(batches: Iterator[pa.RecordBatch], j=j) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                    try:
                        yield _batch([(bi, bj, np.linalg.cholesky(np.frombuffer(raw).reshape(grid.shape(j, j))))])
                    except np.linalg.LinAlgError:
                        pass  # no row says so

        first = now.where((F.col("bi") == j) & (F.col("bj") == j)).mapInArrow(factor, BLOCKS).first()  # one block
        if first is None:
            raise np.linalg.LinAlgError("the matrix is not positive definite")
        diagonal = np.frombuffer(first["block"]).reshape(grid.shape(j, j))

        def finish(batches: Iterator[pa.RecordBatch], j=j, diagonal=diagonal) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                    yield _batch([(bi, bj, diagonal if bi == j else np.linalg.solve(diagonal, np.frombuffer(raw).reshape(grid.shape(bi, bj)).T).T)])

        column = stored(now.where(F.col("bj") == j).mapInArrow(finish, BLOCKS), "column")
        done.append(column)
        if j + 1 == n:
            break
        base = now.where(F.col("bj") > j).select("bi", "bj", F.lit(0).alias("side"), "block")
        below = column.where(F.col("bi") > j)
        left = below.select("bi", F.lit(1).alias("side"), "block").withColumn("bj", F.explode(F.sequence(F.lit(j + 1), F.col("bi"))))
        right = below.select(F.col("bi").alias("bj"), F.lit(2).alias("side"), "block").withColumn("bi", F.explode(F.sequence(F.col("bj"), F.lit(n - 1))))

        def take(state, r, j=j):
            (bi, bj), x, hold = state
            side, raw = r
            if side == 0:
                x = np.array(np.frombuffer(raw).reshape(grid.shape(bi, bj)))
            elif side == 1:
                hold = np.frombuffer(raw).reshape(grid.shape(bi, j))
            elif hold is not None:
                x = (np.zeros(grid.shape(bi, bj)) if x is None else x) - hold @ np.frombuffer(raw).reshape(grid.shape(bj, j) if bi != bj else hold.shape).T
            return (bi, bj), x, hold

        parts = base.unionByName(left.select("bi", "bj", "side", "block")).unionByName(right.select("bi", "bj", "side", "block"))
        before, now = now, stored(_streamed(parts, ["bi", "bj"], ["side"], BLOCKS, lambda key: (key, None, None), take, lambda s: np.zeros(grid.shape(*s[0])) if s[1] is None else s[1]), "left")
        dropped(before)
    dropped(now)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return Blocked(out, grid)


# --- leading eigenpairs ---------------------------------------------------------------


def _wide(m: Blocked, k: int) -> tuple[DataFrame, list[str]]:
    """A matrix of one block column as rows (i, c0 ...)."""
    names, grid = [f"c{c}" for c in range(k)], m.grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                x = np.frombuffer(raw).reshape(grid.shape(bi, bj))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) + bi * grid.size), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["i", *names])

    return m.df.mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names)), names


def eigh(a: Blocked, k: int, *, more: int = 10, tolerance: float = 1e-10, rounds: int = 200, seed: int = 7) -> tuple[np.ndarray, Blocked]:
    """The k eigenvalues of largest absolute value of a symmetric matrix, in descending order of it, and their vectors as columns.

    Subspace iteration with k + more vectors: a distributed product, made orthogonal by the
    tall QR, and the small eigenproblem of what is left on the driver, until every residual is
    under tolerance times the largest value, or for so many rounds.
    """
    width = min(k + more, a.rows, a.size, tall.SMALL)
    if k > width:
        raise ValueError("too many pairs are asked for")
    grid = Grid(a.rows, width, a.size)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi in batch.column(0).to_pylist():
                yield _batch([(bi, 0, np.random.default_rng([seed, bi]).standard_normal(grid.shape(bi, 0)))])

    start = a.df.sparkSession.range(grid.down).mapInArrow(begin, BLOCKS)
    held = kept(a, "matrix")
    q = _orthogonal(Blocked(start, grid))
    for _ in range(rounds):
        z = kept(matmul(held, q), "product")
        small = _cross(q, z)  # q' a q
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:k]
        values, vectors = values[order], vectors[:, order]
        # |a q v - w q v| squared, from the small products alone would lose digits: it is taken from the rows.
        gap = _residual(q, z, vectors, values)
        if gap.max() <= tolerance * max(np.abs(values).max(), 1e-300):
            break
        before, q = q, _orthogonal(z)
        dropped(before.df, z.df)
    return values, _mapped(q, vectors)


def _mapped(m: Blocked, by: np.ndarray) -> Blocked:
    """A matrix of one block column times a small one."""
    grid = m.grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, raw in zip(*[c.to_pylist() for c in batch.columns]):
                yield _batch([(bi, bj, np.frombuffer(raw).reshape(grid.shape(bi, bj)) @ by)])

    return Blocked(m.df.mapInArrow(run, BLOCKS), Grid(m.rows, by.shape[1], m.size))


def _orthogonal(m: Blocked) -> Blocked:
    """An orthogonal basis of the columns of a matrix of one block column; directions that are lost to rounding are left as they come."""
    wide, names = _wide(m, m.columns)
    r = tall.r_factor(wide, names)
    u, s, vt = np.linalg.svd(r)
    return kept(_mapped(m, vt.T / np.where(s > 1e-14 * s[0], s, 1.0)), "basis")


def _pair(q: Blocked, z: Blocked) -> DataFrame:
    return q.df.select("bi", F.col("block").alias("x")).join(z.df.select("bi", F.col("block").alias("y")), "bi")


def _cross(q: Blocked, z: Blocked) -> np.ndarray:
    shape = (q.columns, z.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                own = np.frombuffer(x).reshape(-1, shape[0]).T @ np.frombuffer(y).reshape(-1, shape[1])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return tall.combined(_pair(q, z).mapInArrow(run, "m binary"), lambda ms: np.sum(ms, 0)).reshape(shape)


def _residual(q: Blocked, z: Blocked, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    width = q.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(values))
        for batch in batches:
            for _, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                gap = np.frombuffer(y).reshape(-1, width) @ vectors - np.frombuffer(x).reshape(-1, width) @ vectors * values
                total += (gap * gap).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return np.sqrt(tall.combined(_pair(q, z).mapInArrow(run, "m binary"), lambda ms: np.sum(ms, 0)))
