"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

Both tokenizations cut a text's bytes at ascending ends. Merging the ends of A and B is a
walk of n_a + n_b steps. Its diagonals, found by binary search, cut it into pieces of equal
work that need nothing of each other: a piece emits the overlaps it walks over and the
places where both end; sums over the pieces before it stitch groups that cross pieces. All
pieces of a batch are walked side by side. Links of pairs of ids are counted over all
documents, and each document is scored by these counts.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import spelled
from millrace.llm.common import discard, mapped, pieces, written
from millrace.llm.token_store import Encoder

#: Steps of the merge in a piece.
STEP = 32
#: Bytes of text that are encoded and aligned at once.
PIECE = 1 << 18
#: Pairs of ids that are sent to all tasks at once (17 bytes each); a count table with more is met in slices.
SLICE = 2_000_000
#: Pairs that a task of the count adds up before it hands them on.
TOGETHER = 1 << 20
SPACE_MARK = "▁"


# --- the merge ------------------------------------------------------------------------


def split_paths(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the merges of several documents' ends: the document of each, the places in a and b where it starts, and its steps.

    a, b: ends, ascending within each document; a_cut, b_cut: bounds of the documents. Of equal ends, A's comes first.
    """
    n_a, n_b = np.diff(a_cut), np.diff(b_cut)
    many = -(-(n_a + n_b) // step)
    doc = np.repeat(np.arange(len(n_a)), many)
    diagonal = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * step
    from_a, from_b = a_cut[doc], b_cut[doc]
    low, high = np.maximum(0, diagonal - n_b[doc]), np.minimum(diagonal, n_a[doc])
    while (low < high).any():  # the least i for which a's i-th end comes after b's end at diagonal - i - 1
        mid, on = (low + high) // 2, low < high
        before = a[np.minimum(from_a + mid, len(a) - 1)] <= b[np.clip(from_b + diagonal - mid - 1, 0, len(b) - 1)]
        low, high = np.where(on & before, mid + 1, low), np.where(on & ~before, mid, high)
    return doc, from_a + low, from_b + diagonal - low, np.minimum(step, n_a[doc] + n_b[doc] - diagonal)


def overlaps(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping pairs of tokens, as places in a and b in the order of the merge, and the group of each token of a and of b.

    Groups are numbered through all documents; one ends wherever a token of a and one of b end. A document has tokens on both sides or on neither.
    """
    doc, i, j, left = split_paths(a, b, a_cut, b_cut, step)
    end_a, end_b = a_cut[doc + 1], b_cut[doc + 1]
    a_next, b_next = np.append(a, 0), np.append(b, 0)
    link_a, link_b = np.full((step, len(i)), -1, np.int64), np.full((step, len(i)), -1, np.int64)
    both_a, both_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    # Bytes that the walk has passed: two tokens overlap where both end beyond them.
    past = np.maximum(np.where(i > a_cut[doc], a_next[i - 1], 0), np.where(j > b_cut[doc], b_next[j - 1], 0))
    for t in range(step):
        on, has_a, has_b = left > t, i < end_a, j < end_b
        x, y = a_next[i], b_next[j]
        meets = on & has_a & has_b & (past < x) & (past < y)
        link_a[t, meets], link_b[t, meets] = i[meets], j[meets]
        takes_a = on & has_a & (~has_b | (x <= y))
        takes_b = on & ~takes_a
        same = takes_a & has_b & (x == y)
        both_a[i[same]], both_b[j[same]] = True, True
        past = np.where(takes_a, x, np.where(takes_b, y, past))
        i, j = i + takes_a, j + takes_b
    link_a, link_b = link_a.T.ravel(), link_b.T.ravel()
    good = link_a >= 0
    # A group may span pieces: it is known by the common ends before it, summed over all pieces.
    group_a, group_b = (np.cumsum(both) - both for both in (both_a, both_b))
    return link_a[good], link_b[good], group_a, group_b


# --- the tokenizers -------------------------------------------------------------------


@functools.cache
def _unspelled() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write: printable ones are themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum(sizes)[:-1]), sizes


class Pair:
    """Both tokenizers, and the bytes of every id of either."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _unspelled()
        entries = sorted((i, e) for e, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items())
        spelling = [b""] * (entries[-1][0] + 1)
        for i, e in entries:
            spelling[i] = bytes([letters[c] for c in e]) if all(c in letters for c in e) else e.encode()
        self.a_bytes = _table(spelling)
        self.b_bytes = _table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))])

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B of all texts end to end, and the bounds of the texts; none for texts without tokens."""
        spaced = [b" " + t if t else b"" for t in texts]
        a = [np.asarray(x, np.int32) for x in self.a(spaced)]
        b = [np.asarray(x, np.int32) for x in self.b.encode([(t or b"").decode("utf-8", "replace") for t in texts], num_threads=1)]
        for k, t in enumerate(spaced):
            if not t or not self._spells(a[k], self.a_bytes, t) or not self._spells(b[k], self.b_bytes, t):
                a[k] = b[k] = np.empty(0, np.int32)
        out = []
        for x in (a, b):
            out += [np.concatenate([np.empty(0, np.int32), *x]), np.append(0, np.cumsum([len(v) for v in x])).astype(np.int64)]
        return out[0], out[2], out[1], out[3]

    @staticmethod
    def _spells(ids: np.ndarray, table, text: bytes) -> bool:
        return int(table[2][ids].sum()) == len(text) and spelled(ids, table).tobytes() == text


@functools.cache
def pair(a_path: str, b_path: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Pair(a_path, b_path)


def _ends(ids: np.ndarray, cut: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens within their documents."""
    ends = np.cumsum(sizes[ids])
    base = np.append(0, ends)[cut[:-1]]
    return ends - np.repeat(base, np.diff(cut))


# --- the operator ---------------------------------------------------------------------


ENCODED = "doc_id long, a binary, b binary, n_best long, count_sum long"


def encoded(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of both tokenizers (16 or 32 bits each, as the vocabulary needs) of each row, and sums that are 0 so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        kinds = [_width(t) for t in (both.a_bytes, both.b_bytes)]
        for batch in batches:
            for part, texts in pieces(batch, 1, PIECE):
                a, b, a_cut, b_cut = both(texts)
                cols = []
                for ids, cut, kind in ((a, a_cut, kinds[0]), (b, b_cut, kinds[1])):
                    raw, n = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                    cols.append(pa.array([raw[n * x : n * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()))
                none = pa.array(np.zeros(len(texts), np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, none, none], names=["doc_id", "a", "b", "n_best", "count_sum"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, ENCODED)


def _width(table) -> str:
    return "<u2" if len(table[2]) <= 1 << 16 else "<u4"


def _links(batch: pa.RecordBatch, both: Pair):
    """For pieces of a batch of encoded rows: the rows, ids and bounds of both sides, overlaps and groups."""
    for part, left in pieces(batch, 1, PIECE):
        ids, cuts = [], []
        for values, table in ((left, both.a_bytes), (part.column(2).to_pylist(), both.b_bytes)):
            kind = _width(table)
            ids.append(np.frombuffer(b"".join(values), kind).astype(np.int64))
            cuts.append(np.append(0, np.cumsum([len(v) // np.dtype(kind).itemsize for v in values])).astype(np.int64))
        ends = [_ends(x, cut, table[2]) for x, cut, table in zip(ids, cuts, (both.a_bytes, both.b_bytes))]
        yield part, ids, cuts, overlaps(*ends, *cuts)


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair (A's id in the upper 32 bits, B's in the lower), b and n: links over all rows that hold the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, both = [], 0, pair(a_path, b_path)

        def added() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            return key[first], np.add.reduceat(n, first)

        for batch in batches:
            for _, ids, _, (x, y, _, _) in _links(batch, both):
                if len(x):
                    held.append(np.unique((ids[0][x] << 32) | ids[1][y], return_counts=True))
                    size += len(held[-1][0])
                if size > 2 * TOGETHER:
                    held = [added()]
                    size = len(held[0][0])
                    if size > TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["pair", "n"])
                        held, size = [], 0
        if held:
            key, n = added()
            for low in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[low : low + (1 << 16)]), pa.array(n[low : low + (1 << 16)])], names=["pair", "n"])

    found = mapped(rows, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return found.select("pair", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")


@functools.cache
def _grouped_decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal ids each with what follows it: a comma, a bar or a semicolon."""
    return _table([b"%d%c" % (i, c) for c in b",|;" for i in range(n)])


def group_digests(ids: list[np.ndarray], cuts: list[np.ndarray], groups: list[np.ndarray], vocabulary: int) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` of each document; '' without tokens."""
    side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
    token, group = np.concatenate(ids), np.concatenate(groups)
    rank = 2 * group + side
    order = np.argsort(rank, kind="stable")
    token, rank = token[order], rank[order]
    ends = np.append(rank[1:] != rank[:-1], True) if len(rank) else np.empty(0, bool)
    table = _grouped_decimals(vocabulary)
    kind = np.where(ends, 1 + rank % 2, 0)
    chosen = token + kind * vocabulary
    text, sizes = spelled(chosen, table).tobytes(), table[2][chosen]
    at = np.append(0, np.cumsum(sizes))[cuts[0] + cuts[1]]
    return [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scored(rows: DataFrame, a_path: str, b_path: str, part: tuple[np.ndarray, np.ndarray, np.ndarray], last: bool) -> DataFrame:
    """rows with what a slice of the count table adds to their sums; of the last slice, the results."""
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = shared.value
        both = pair(a_path, b_path)
        vocabulary = max(len(both.a_bytes[2]), len(both.b_bytes[2]))
        for batch in batches:
            for some, ids, cuts, (x, y, group_a, group_b) in _links(batch, both):
                at, there = _place(key, (ids[0][x] << 32) | ids[1][y])
                owner = np.searchsorted(cuts[0][1:], x, "right")
                add = lambda values: np.bincount(owner[there], values[at[there]], minlength=len(some)).astype(np.int64)  # noqa: B023, E731
                sums = [np.asarray(some.column(3)) + add(best), np.asarray(some.column(4)) + _sums(owner[there], n[at[there]], len(some))]
                if not last:
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], *map(pa.array, sums)], names=some.schema.names)
                    continue
                n_a, n_b = (np.diff(c) for c in cuts)
                full = n_a > 0
                n_groups = np.zeros(len(some), np.int64)
                n_groups[full] = group_a[cuts[0][1:][full] - 1] - group_a[cuts[0][:-1][full]] + 1
                digests = group_digests(ids, cuts, [group_a, group_b], vocabulary)
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, (n_a, n_b, n_groups, np.bincount(owner, minlength=len(some)).astype(np.int64), *sums)), pa.array(digests, pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return mapped(rows, run, RESULT if last else ENCODED)


def _place(key: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each pair in the slice, and whether it is there."""
    if not len(key):
        return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    at = np.minimum(np.searchsorted(key, pairs), len(key) - 1)
    return at, key[at] == pairs


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by ascending owner."""
    total = np.append(0, np.cumsum(values))
    bound = np.searchsorted(owner, np.arange(n + 1))
    return total[bound[1:]] - total[bound[:-1]]


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", *, slice_pairs: int = SLICE) -> DataFrame:
    """For each row: tokens of A (a tokenizers file; of a space and the text) and B (a sentencepiece model, which adds the space),
    groups between the places where both end, links (overlapping pairs of tokens), and what the links' counts over all rows say.

    n_best: links whose pair has the most links of all pairs of its B id, ties included;
    count_sum: the sum of the links' counts. Null and empty texts, and those that either
    tokenizer does not give back byte for byte, have no tokens: zeros and ''. Special tokens'
    strings are plain text. Repeated rows each count. Other columns are not read.

    The texts are encoded once. The count table goes to the tasks in slices of at most about
    slice_pairs pairs, as a rule one; each slice adds its part to the rows' sums.
    """
    rows = written(encoded(df, a_path, b_path, id_col, text_col), "encoded")
    counts = written(pair_counts(rows, a_path, b_path), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    marked = written(counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")
    discard(counts)
    parts = max(1, -(-marked.count() // slice_pairs))
    for k in range(parts):
        own = marked if parts == 1 else marked.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k)
        got = own.toArrow()
        order = np.argsort(got.column(0).to_numpy())
        part = tuple(np.asarray(got.column(c).to_numpy())[order] for c in range(3))
        before, rows = rows, written(scored(rows, a_path, b_path, part, k == parts - 1), "aligned")
        discard(before)
    discard(marked)
    return rows
