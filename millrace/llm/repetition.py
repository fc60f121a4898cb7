"""Quality rules: base counts of a text, and repetition found with a suffix array.

The suffix array of a document's words is built by prefix doubling. The ranks of each
doubling give the longest common prefix of neighbours in suffix order, and the LCP
intervals so found are the maximal repeated substrings. Their spans are joined; a document
is rejected when they cover too large a part of its characters or when one is too long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import WHITE, with_columns

SYMBOLS = b"#*$%&|<>"
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("covered_fraction", T.DoubleType()), T.StructField("longest_repeat", T.LongType()), T.StructField("repeat_spans", SPAN),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
]


def dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of keys in sorted order, equal keys alike, and how many there are."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    steps = np.empty(len(keys), np.int64)
    steps[:1] = 0
    np.cumsum(ranked[1:] != ranked[:-1], out=steps[1:])
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = steps
    return ranks, int(steps[-1]) + 1 if len(keys) else 0


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ids in order, and the LCP of each with its predecessor (0 for the first)."""
    n = len(ids)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank, distinct = dense(np.asarray(ids, np.int64))
    small = np.int32 if n < 1 << 31 else np.int64
    levels, width = [rank.astype(small)], 1
    while distinct < n:
        tail = np.zeros(n, np.int64)
        tail[: max(0, n - width)] = rank[width:] + 1  # 0: past the end, before all else
        rank, distinct = dense(rank * (n + 1) + tail)
        levels.append(rank.astype(small))
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for k in range(len(levels) - 2, -1, -1):  # ranks of different suffixes are equal only if their first 2**k items are
        inside = np.flatnonzero(np.maximum(left, right) < n)
        same = inside[levels[k][left[inside]] == levels[k][right[inside]]]
        lcp[1:][same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    return order, lcp


def maximal_repeats(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and ends of the union of all repeated substrings of at least so many items, and the longest one's length."""
    order, lcp = suffix_array(ids)
    none = np.empty(0, np.int64)
    if not len(order) or lcp.max() < least:
        return none, none, int(lcp.max()) if len(lcp) else 0
    reach = np.zeros(len(order), np.int64)
    reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))  # the deepest LCP interval that each suffix is in
    starts = np.flatnonzero(reach >= least)
    ends = np.maximum.accumulate(starts + reach[starts])
    first = np.append(True, starts[1:] > ends[:-1])
    last = np.append(first[1:], True)
    return starts[first], ends[last], int(lcp.max())


def repeated_windows(ids: np.ndarray, size: int = 3) -> tuple[int, bool]:
    """How many items lie in windows that occur twice or more, and whether there is such a window."""
    n = len(ids) - size + 1
    if n < 2:
        return 0, False
    key, distinct = ids[:n], int(ids.max()) + 1
    for k in range(1, size):
        if distinct * (int(ids.max()) + 1) >= 1 << 62:
            key, distinct = dense(key)
        key, distinct = key * (int(ids.max()) + 1) + ids[k : k + n], distinct * (int(ids.max()) + 1)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, False
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += hit
    edge[size:] -= hit[: len(ids) + 1 - size]
    return int((np.cumsum(edge[:-1]) > 0).sum()), True


def measure(text: bytes | None, min_repeat: int = 8) -> tuple:
    """Counts of one text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_fraction, longest_repeat, spans."""
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0.0, 0, []
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    chars = len(text.translate(None, WHITE).decode("utf-8", "replace"))
    ids_of: dict[bytes, int] = {}
    ids = np.fromiter([ids_of.setdefault(w, len(ids_of)) for w in words], np.int64, len(words))
    in_windows, any_repeat = repeated_windows(ids)
    spans, covered, longest = [], 0, 0
    if any_repeat or min_repeat < 3:  # longer repeats hold a window of three words
        starts, ends, longest = maximal_repeats(ids, min_repeat)
        if len(starts):
            upto = np.append(0, np.cumsum([len(w.decode("utf-8", "replace")) for w in words]))
            covered = int((upto[ends] - upto[starts]).sum())
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)]
        longest = longest if longest >= min_repeat else 0
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), in_windows, covered / chars, longest, spans


def _judge(min_words: int, max_repeat_percent: int, min_repeat: int, max_covered: float, max_longest: int):
    def make():
        def call(texts):
            rows = [measure(t, min_repeat) for t in texts]
            base = [r[0] < min_words or 100 * r[4] > max_repeat_percent * r[0] for r in rows]
            kept = [not b and r[5] <= max_covered and r[6] <= max_longest for b, r in zip(base, rows)]
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            return [*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), pa.array(base, pa.bool_()), pa.array(kept, pa.bool_())]

        return call

    return make


def quality_rules(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, *, only_kept: bool = False, min_words: int = 50, max_repeat_percent: int = 50, min_repeat: int = 8, max_covered: float = 0.5, max_longest: int = 200) -> DataFrame:
    """Judges every whole text; one row out for each row in.

    Adds the base counts, the part of the characters inside maximal repeats of at least
    min_repeat words, the longest repeat and the joined word spans [start, end), base_failed
    and kept. only_kept: gives the kept rows with df's own columns instead.

    Null and empty texts have no words: all counts 0, base_failed, not kept. Symbols count
    in texts without words too. Repeated rows are judged alike, each on its own. Columns of
    df named like a result give way to it. A text of one word repeated is one maximal repeat.
    A null row id is passed on. Texts of any length are read whole; memory grows with one text.
    """
    return with_columns(df, text_col, FIELDS, _judge(min_words, max_repeat_percent, min_repeat, max_covered, max_longest), keep, "kept" if only_kept else None)
