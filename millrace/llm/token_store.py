"""A store of token ids for reading single documents.

Ids are written in ascending document order. Each document's serialised ids are one
zstandard frame, compressed with a dictionary that was trained on serialised id arrays of a
bounded sample; blocks of frames carry the dictionary's hash and an index of byte and token
offsets, so that one short document is read without the others.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import crc32_of, mapped, mix64, pieces, shared_dir, shuffle_partitions

#: Documents whose ids train the dictionary, those of the least hashed ids, and the bytes of their serialised ids: the bound of what one task holds.
SAMPLE, SAMPLE_BYTES = 1500, 64 << 20
#: New stretches that are encoded as one text.
TOGETHER = 50
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
LEVEL = 3
END = 0


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_SHORT = (mix64(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # leads of all white space beyond ASCII


def stretch_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where stretches start in texts laid end to end: at each text, and at each single space between two
    characters that are surely not white space. The split pattern ends a match there in any context."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    left, right = data[at - 1], data[at + 1]
    sure = _SOLID[left] & _SOLID[right] & ~_WIDE_LEAD[right]
    wide = sure & (left >= 0x80)
    sure &= ~(wide & (_WIDE_LEAD[data[at - 2]] | _WIDE_LEAD[data[at - 3]]))
    marks = np.zeros(len(data), bool)
    marks[text_starts[text_starts < len(data)]] = True
    marks[at[sure]] = True
    return np.flatnonzero(marks)


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _A, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def splits_at_spaces(path: str) -> bool:
    """Whether the file's tokenizer ends a match at each single space inside text: the byte-level split with its own pattern, and no normalizer."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    return not made.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)


class Encoder:
    """Texts to ids by a tokenizer file, each different stretch of text encoded by the library once.

    Stretches are known by a 64-bit and a 32-bit hash in an open-addressing table of arrays,
    which is emptied when 60 % full and widened only for a text with more stretches than that:
    memory is bounded, and no Python object is kept for a stretch. Texts with the string of an
    added token go to the library whole, as do all texts of a tokenizer that does not split at
    single spaces.
    """

    def __init__(self, path: str, bits: int = 20, special: bool = True):
        """special=False: strings of special tokens are plain text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.least_bits = Tokenizer.from_file(path), bits
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and (special or not t.special)]
        self.by_stretch = splits_at_spaces(path)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear(bits)

    def clear(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.checks, self.entry, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.int32), 0
        self.ids, self.bounds = np.empty(1 << 16, "<u4"), np.zeros(1 << 12, np.int64)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each pair of hashes, -1 where it has none."""
        slot, out, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(todo):
            at = slot[todo]
            key = self.keys[at]
            hit = (key == h[todo]) & (self.checks[at] == check[todo])
            out[todo[hit]] = self.entry[at[hit]]
            todo = todo[~hit & (key != 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """h, check: different pairs that have no entry; there must be places for all. ids: those of each, end to end."""
        n, top = self.used, int(self.bounds[self.used])
        while top + sizes.sum() > len(self.ids):
            self.ids = np.append(self.ids, np.empty_like(self.ids))
        while n + len(h) + 1 > len(self.bounds):
            self.bounds = np.append(self.bounds, np.empty_like(self.bounds))
        self.ids[top : top + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(h)] = top + np.cumsum(sizes)
        slot, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            got = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[got]], self.checks[slot[got]], self.entry[slot[got]] = h[got], check[got], n + got
            left = np.ones(len(h), bool)
            left[got] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.used += len(h)

    def library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def learn(self, h: np.ndarray, check: np.ndarray, stretches: list[bytes], plain: np.ndarray) -> None:
        """Encodes stretches that have no entry. plain: those of a space and characters that are surely not white space;
        a line feed between such ones is a match of its own, so that some dozen go to the library as one text."""
        if plain.any() and len(self.feed) == 1:
            at = np.flatnonzero(plain)
            groups = [b"\n".join([stretches[k] for k in at[low : low + TOGETHER].tolist()]) for low in range(0, len(at), TOGETHER)]
            found = self.library(groups)
            ids = np.fromiter(itertools.chain.from_iterable(x + self.feed for x in found), "<u4", sum(map(len, found)) + len(found))
            ends = np.flatnonzero(ids == self.feed[0])
            if len(ends) != len(at):
                raise ValueError("a line feed was joined with a stretch")
            self.add(h[at], check[at], np.delete(ids, ends), np.diff(np.append(-1, ends)) - 1)
        other = np.flatnonzero(~plain) if len(self.feed) == 1 else np.arange(len(h))
        if len(other):
            found = self.library([stretches[k] for k in other.tolist()])
            sizes = np.array([len(x) for x in found], np.int64)
            self.add(h[other], check[other], np.fromiter(itertools.chain.from_iterable(found), "<u4", int(sizes.sum())), sizes)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_stretch:
            return [np.array(x, "<u4") for x in self.library(texts)]
        joined = b"".join(texts)
        if any(a in joined for a in self.added):
            apart = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
            out = self.by_stretches([b"" if k in set(apart) else t for k, t in enumerate(texts)])
            for k, ids in zip(apart, self.library([texts[k] for k in apart])):
                out[k] = np.array(ids, "<u4")
            return out
        return self.by_stretches(texts)

    def by_stretches(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        text_ends = np.cumsum([len(t) for t in texts])
        if not len(data):
            return [np.empty(0, "<u4")] * len(texts)
        starts = stretch_starts(data, text_ends - [len(t) for t in texts])
        sizes = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        bits = _BYTE[data]
        bits *= _powers(1 << max(6, int(sizes.max() - 1).bit_length()))[place]
        h = mix64(np.add.reduceat(bits, starts) + sizes.astype(np.uint64) * _B) | np.uint64(1)
        del bits
        place *= 2
        place += 0x3779B97
        check = np.add.reduceat(_SHORT[data] * place.view(np.uint32), starts, dtype=np.uint32)
        del place
        found = self.find(h, check)
        if (found < 0).any():
            plain = (np.add.reduceat(~_SOLID[data] | _WIDE_LEAD[data], starts, dtype=np.int32) == 1) & (data[starts] == 0x20)
            at = self._new(h, check, np.flatnonzero(found < 0))
            if self.used + len(at) > 0.6 * (1 << self.bits):
                at = self._new(h, check, np.arange(len(h)))
                self.clear(max(self.least_bits, int(np.ceil(np.log2(len(at) / 0.6 + 1)))))
            for low in range(0, len(at), 5000):
                some = at[low : low + 5000]
                self.learn(h[some], check[some], [joined[a : a + n] for a, n in zip(starts[some].tolist(), sizes[some].tolist())], plain[some])
            found = self.find(h, check)
        begin, n = self.bounds[found], self.bounds[found + 1] - self.bounds[found]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(begin - ends + n, n) + np.arange(ends[-1])]
        cut = np.append(0, ends)[np.searchsorted(starts, text_ends)]
        return np.split(ids, cut[:-1])

    @staticmethod
    def _new(h: np.ndarray, check: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first of each pair of hashes among these places."""
        order = at[np.lexsort((check[at], h[at]))]
        first = np.append(True, (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]]))
        return order[first]


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def _codec(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def _texts(values: list[bytes | None]) -> list[bytes]:
    return [v or b"" for v in values]


#: Bytes of text that are encoded at once.
PIECE = 1 << 19


def train_dictionary(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> bytes:
    """A dictionary from the whole serialised ids of at most `sample` documents, SAMPLE_BYTES in all; of rows with one id the least text counts. Empty where there is too little to learn from."""
    some = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    chosen = F.broadcast(some.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, blobs, size = _encoder(tokenizer_path), [], 0
        for batch in batches:
            for _, values in pieces(batch, 1, PIECE):
                for x in encode(_texts(values)) if size < SAMPLE_BYTES else []:
                    blob = np.append(x, np.uint32(END)).astype("<u4").tobytes()
                    if size + len(blob) <= SAMPLE_BYTES:
                        blobs.append(blob)
                        size += len(blob)
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, blobs).as_bytes()
        except zstandard.ZstdError:  # too few samples
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    own = some.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"))
    rows = own.coalesce(1).sortWithinPartitions("id").mapInArrow(run, "dictionary binary").collect()
    return next((bytes(r["dictionary"]) for r in rows if r["dictionary"]), b"")


BLOCKS = "part int, block int, dictionary_sha256 string, n_tokens long, doc_ids array<long>, token_starts array<long>, byte_offsets array<long>, frames binary"


def _block(part: int, k: int, sha: str, rows: list[tuple[int | None, int, bytes]], before: int) -> pa.RecordBatch:
    tokens = np.append(0, np.cumsum([n for _, n, _ in rows])).astype(np.int64)
    offsets = np.append(0, np.cumsum([len(f) for _, _, f in rows])).astype(np.int64)
    many = pa.list_(pa.int64())
    cols = [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([sha]), pa.array([int(tokens[-1])], pa.int64()), pa.array([[i for i, _, _ in rows]], many), pa.array([tokens + before], many), pa.array([offsets], many), pa.array([b"".join(f for _, _, f in rows)], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BLOCKS.split(", ")])


def write(df: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the store: `blocks` (frames and their index), `dictionary` and `parts` (tokens before each part).

    Null texts are empty; each document ends with id 0. Documents are in ascending order of
    id, nulls first, repeated ids by text. Documents are dealt into ranges of ids before they
    are encoded; a task streams through its range and holds one block.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark, "tokens")
    dictionary = train_dictionary(df, tokenizer_path, id_col, text_col)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compressor = _encoder(tokenizer_path), _codec(dictionary)[0]
        part, k, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for some, values in pieces(batch, 1, PIECE):
                for i, ids in zip(some.column(0).to_pylist(), encode(_texts(values))):
                    frame = compressor.compress(ids.tobytes() + END.to_bytes(4, "little"))
                    held.append((i, len(ids) + 1, frame))
                    size += len(frame)
                    if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                        yield _block(part, k, sha, held, before)
                        before += sum(n for _, n, _ in held)
                        k, held, size = k + 1, [], 0
        if held:
            yield _block(part, k, sha, held, before)

    # Frames are compressed already.
    mapped(rows, run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums.select("part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("tokens_before")).coalesce(1).write.parquet(f"{path}/parts")
    return path


def load_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary's hash is wrong")
    return row["sha256"], bytes(row["dictionary"])


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens, ids_crc32, and with ids=True the ids."""
    sha, dictionary = load_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part")  # parts: a row for each task that wrote
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = _codec(dictionary)[1]
        for batch in batches:
            for own, docs, starts, offsets, frames, base in zip(*[c.to_pylist() for c in batch.columns]):
                if own != sha:
                    raise ValueError("a block was written with another dictionary")
                raw = [decompressor.decompress(frames[a:b]) for a, b in zip(offsets, offsets[1:])]
                begin = np.array(starts[:-1], np.int64) + base
                cols = [pa.array(docs, pa.int64()), pa.array(begin), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([crc32_of(x) for x in raw], pa.int64())]
                if ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return mapped(blocks.select("dictionary_sha256", "doc_ids", "token_starts", "byte_offsets", "frames", "tokens_before"), run, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document: its block is found by the index, and only its frame is decompressed."""
    _, dictionary = load_dictionary(spark, path)
    at = f"int(array_position(doc_ids, {int(doc_id)}L))"
    low, high = f"element_at(byte_offsets, {at})", f"element_at(byte_offsets, {at} + 1)"
    found = spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    row = found.select(F.expr(f"substring(frames, int({low}) + 1, int({high} - {low}))").alias("frame")).first()
    return None if row is None else np.frombuffer(_codec(dictionary)[1].decompress(bytes(row["frame"])), "<u4")
