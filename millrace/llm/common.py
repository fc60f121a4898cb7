"""What the operators share: a folder that every executor sees, tables written there to
cut lineage, and Arrow batches dealt out in pieces of bounded size."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.shared import shared_dir

#: Bytes of text that one call of a batch function gets; a single longer text comes alone. Arrays over its
#: bytes take 25 to 40 times as much for a moment.
PIECE_BYTES = 1 << 20
#: ASCII white space, the word separators of every contract: 0x20 and 0x09 to 0x0D.
WHITE = b" \t\n\x0b\x0c\r"

_MASK = (1 << 64) - 1


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df, written to the shared folder and read again, so that a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_millrace_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow; at the end of each task the worker, which Spark keeps, gives back the memory it has freed."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Recent:
    """Ids met lately, in a table of one place for each hash (8 MB): a saving only, as an id that is forgotten comes again."""

    def __init__(self, bits: int = 20):
        self.table = np.zeros(1 << bits, np.int64)
        self.table[0] = 8  # no free place holds an id that belongs there

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        """Which ids have not been met, each once; from now on they have."""
        slot = (ids.view(np.uint64) >> np.uint64(3)) & np.uint64(len(self.table) - 1)
        new = self.table[slot] != ids
        first = np.zeros(len(ids), bool)
        first[np.unique(ids, return_index=True)[1]] = True
        self.table[slot] = ids
        return new & first


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Has texts go to Python in Arrow batches of so many rows at most, as some are long; a smaller setting stays.

    It is a setting of the session: applications (the queries and the pipeline) make it, the
    operators don't.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    return spark


#: Rows of a few numbers (under 40 bytes each), or items of lists in rows, up to which a table is sent to all tasks.
FEW = 300_000


def few_to_all(df: DataFrame, most: int = FEW, items: str | None = None) -> DataFrame:
    """df, a written table of narrow rows, with a broadcast hint if it has at most so many rows, or items in a list column; beyond that joins shuffle both sides."""
    n = df.count() if items is None else df.agg(F.coalesce(F.sum(F.size(items)), F.lit(0)) + F.count(F.lit(1))).first()[0]
    return F.broadcast(df) if n <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add under the same names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch of at most so many bytes in a column, with that column's values as bytes."""
    values = batch.column(column)
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0), dtype=np.int64)
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low), values.slice(low, high - low).to_pylist()
        low = high


def with_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable], keep: list[str] | None = None, where: str | None = None) -> DataFrame:
    """df's columns (or those in keep), and fields computed from whole texts.

    make() runs once a task and gives a function from a list of UTF-8 texts (None: null) to
    a list of columns. Columns of df with the name of a new field give way to it. where
    names a boolean field: only rows with a true one stay, and no new column is added.
    """
    base = df if keep is None else df.select(*[F.col(f"`{c}`") for c in keep])
    base = base if where else own_names(base, [f.name for f in fields])
    held = len(base.columns)
    src = base if where and text_col in base.columns else base.withColumn("__text", df[text_col]) if text_col in base.columns else df.select(*[df[c] for c in base.columns], df[text_col].alias("__text"))
    at = src.columns.index(text_col) if where and text_col in base.columns else held
    schema = base.schema if where else T.StructType([*base.schema.fields, *fields])
    names, position = list(schema.names), next((i for i, f in enumerate(fields) if f.name == where), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for part, texts in pieces(batch, at):
                new = call(texts)
                if position is not None:
                    yield pa.RecordBatch.from_arrays(part.columns[:held], names=names).filter(pa.array(new[position], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns[:held], *(x if isinstance(x, pa.Array) else pa.array(x) for x in new)], names=names)

    return mapped(src, run, schema)


def crc32_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo a number; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def crc32_of(value: bytes) -> int:
    return zlib.crc32(value) & 0xFFFFFFFF


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
