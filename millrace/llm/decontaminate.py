"""Benchmark decontamination by canonical templates.

Words are canonicalised: numbers, units and names become typed placeholders, whose surface
forms are the slots. Windows of the canonical words of benchmark items are hash-joined with
those of documents. Matched windows of an item are chained in the order of both texts, with
some words more or fewer between them. Windows that are equal word for word count by
themselves; of the others those whose slots map consistently from the item to the document
count too. What they cover says whether the document holds the item.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import few_to_all, mapped, mix64, pieces, written

#: Units that count as such after a number.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "euros", "euro", "dollars", "dollar", "cents", "percent", "%", "$", "€", "miles", "feet", "inches", "pounds", "kilometers", "meters", "grams", "litres", "liters"]
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
_NUMERIC = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?")
_GLUED = re.compile(r"([+-]?\d[\d.,:/]*)([a-z]+)", re.IGNORECASE)
_EDGE = ".,;:!?\"'()[]{}«»“”"
_STOP = re.compile(r"[.!?:][\"')\]»”]*$")
_UNITS = frozenset(UNITS)
#: Benchmark windows up to which documents are first looked up in a broadcast set of their hashes (16 bytes each).
SIFT = 2_000_000
WINDOW = 8
#: Words that a document may have more or fewer than the item, all in all: this share of the item's words, and so many at least.
DRIFT_SHARE, DRIFT = 0.5, 16


_NUMERIC_FORM, _UNIT_FORM, _NAME_FORM, _STOPS, _NOTHING, _GLUED_FORM = 1, 2, 4, 8, 16, 32


class Lexicon(dict):
    """Raw word (bytes) -> its row in arrays of hashes and forms; emptied between texts when full."""

    def __init__(self):
        self.hashes, self.forms = array("Q"), array("B")

    def __missing__(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "replace")
        word = text.strip(_EDGE)
        low = (word or text).lower()
        form = _STOPS * bool(_STOP.search(text))
        glued = _GLUED.fullmatch(word)
        if not word and text not in _UNITS:
            form |= _NOTHING
        elif _NUMERIC.fullmatch(word):
            form |= _NUMERIC_FORM
        elif glued and glued[2].lower() in _UNITS:
            form |= _NUMERIC_FORM | _GLUED_FORM
        else:
            form |= _UNIT_FORM * (low in _UNITS) | _NAME_FORM * (len(word) > 1 and word[0].isupper() and word[1:].islower())
        self[raw] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(low))
        self.forms.append(form)
        return n

    def emptied(self, most: int = 150_000) -> "Lexicon":
        if len(self) > most:
            self.clear()
            self.hashes, self.forms = array("Q"), array("B")
        return self


_PLACEHOLDERS = {k: np.uint64(xxhash.xxh3_64_intdigest(v)) for k, v in ((_NUMERIC_FORM, NUMBER), (_UNIT_FORM, UNIT), (_NAME_FORM, NAME))}


@dataclass
class Canonical:
    """Canonical words of several texts: hash, placeholder form (0: none), first and last raw word of each, whether it is
    otherwise when capitalised words at starts are words, the raw words, and the bounds of texts."""

    hashes: np.ndarray
    kinds: np.ndarray
    first: np.ndarray
    last: np.ndarray
    other: np.ndarray
    raw: list[bytes]
    bounds: np.ndarray

    def slots(self, low: int, high: int) -> list[str | None]:
        return [self._surface(i) if self.kinds[i] else None for i in range(low, high)]

    def _surface(self, i: int) -> str:
        words = [_surface(r) for r in self.raw[self.first[i] : self.last[i] + 1]]
        glued = _GLUED.fullmatch(words[-1])
        if glued and glued[2] in _UNITS:
            if self.kinds[i] == _UNIT_FORM:
                return glued[2]
            words[-1] = glued[1]
        return (" " if self.kinds[i] == _NAME_FORM else "").join(words)


def _surface(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return (text.strip(_EDGE) or text).lower()


def canonical(texts: list[bytes | None], lexicon: Lexicon | None = None) -> tuple[Canonical, Canonical]:
    """Canonical words of whole texts, in two readings: capitalised words at the start of a text, line or sentence as words, and as names.

    A number is digits with their signs and separators; numbers in a row are one ("1 000"). A
    unit follows a number, or is written with it ("5km"). A name is a capitalised word of two
    letters or more; names in a row are one ("Mary Ann"). Other words are lower-cased without
    punctuation at their edges; punctuation alone is left out. Units are the English and
    metric ones in UNITS, and a script without capitals has no names.
    """
    lexicon = (Lexicon() if lexicon is None else lexicon).emptied()
    raw, line_starts, bounds = [], [], [0]
    for text in texts:
        for line in (text or b"").split(b"\n"):
            line_starts.append(len(raw))
            raw += line.split()
        bounds.append(len(raw))
    rows = np.fromiter(map(lexicon.__getitem__, raw), np.int64, len(raw))
    hashes, forms = np.frombuffer(lexicon.hashes, np.uint64)[rows] if len(rows) else np.empty(0, np.uint64), np.frombuffer(lexicon.forms, np.uint8)[rows] if len(rows) else np.empty(0, np.uint8)
    starts = np.zeros(len(raw) + 1, bool)
    starts[line_starts] = True
    starts = starts[:-1]
    starts[1:] |= (forms[:-1] & _STOPS) > 0
    at = np.flatnonzero((forms & _NOTHING) == 0)
    hashes, forms, starts = hashes[at], forms[at], starts[at]
    bounds = np.searchsorted(at, bounds)
    glued = (forms & _GLUED_FORM) > 0
    number = (forms & _NUMERIC_FORM) > 0
    first = np.zeros(len(at) + 1, bool)
    first[bounds] = True
    after = np.append(False, (number & ~glued)[:-1]) & ~first[:-1] if len(at) else number
    unit = ((forms & _UNIT_FORM) > 0) & after & ~number
    capital = ((forms & _NAME_FORM) > 0) & ~number & ~unit
    if glued.any():  # a number and its unit are two
        twice = 1 + glued
        bounds = np.append(0, np.cumsum(twice))[bounds]
        second = np.zeros(int(twice.sum()), bool)
        second[(np.cumsum(twice) - 1)[glued]] = True
        hashes, at, starts, capital, number, unit = (np.repeat(x, twice) for x in (hashes, at, starts, capital, number, unit))
        number, unit = number & ~second, unit | second
    text_first = np.zeros(len(at) + 1, bool)
    text_first[bounds] = True
    out = []
    for name in (capital & ~starts, capital):
        kinds = np.select([number, unit, name], [np.uint8(_NUMERIC_FORM), np.uint8(_UNIT_FORM), np.uint8(_NAME_FORM)], np.uint8(0))
        h = hashes.copy()
        for kind, value in _PLACEHOLDERS.items():
            h[kinds == kind] = value
        more = np.zeros(len(at), bool)  # goes on with the placeholder before it
        if len(at) > 1:
            more[1:] = (kinds[1:] == kinds[:-1]) & (number | name)[1:] & ~text_first[1:-1]
        lead = np.flatnonzero(~more)
        changed = np.logical_or.reduceat(capital & starts, lead) if len(lead) else np.empty(0, bool)
        last = np.append(lead[1:], len(at))[: len(lead)] - 1
        out.append(Canonical(h[lead], kinds[lead], at[lead], at[last], changed, raw, np.searchsorted(lead, bounds)))
    return tuple(out)


def window_hashes(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each window of so many canonical words within one text, and the words that windows start at."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : n + j]
    inside = np.ones(n, bool)  # not across two texts
    for edge in bounds[1:-1].tolist():
        inside[max(0, edge - size + 1) : edge] = False
    at = np.flatnonzero(inside)
    return mix64(out[at]).view(np.int64), at


def readings(texts: list[bytes | None], sizes: list[int], lexicon: Lexicon | None = None) -> Iterator[tuple[int, Canonical, int, np.ndarray, np.ndarray]]:
    """Reading (0 or 1), canonical words, window size, hashes and starts of the windows of texts; of the second reading only those that are otherwise."""
    for k, c in enumerate(canonical(texts, lexicon)):
        for size in sizes:
            h, at = window_hashes(c.hashes, c.bounds, size)
            if k and len(at):
                upto = np.append(0, np.cumsum(c.other))
                new = upto[at + size] > upto[at]
                h, at = h[new], at[new]
            yield k, c, size, h, at


def longest_chain(places: list[int]) -> list[int]:
    """Indices of a longest strictly ascending run of places, in order; of equal places the first, which takes in most words of a name."""
    tops, ends, before = [], [], []
    for i, p in enumerate(places):
        k = bisect.bisect_left(tops, p)
        before.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            ends.append(i)
        elif p < tops[k]:
            tops[k], ends[k] = p, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def agreed(windows: list[dict]) -> list[dict]:
    """The windows that are equal word for word, and those whose slots all take the value that most windows have for them (of as
    many, the item's own, then the first by name); a window in which a slot meets a word is neither."""
    votes: dict[str, dict[str | None, int]] = {}
    for w in windows:
        for a, b in set(zip(w["slots"], w["doc_slots"])):
            if a is not None:
                of = votes.setdefault(a, {})
                of[b] = of.get(b, 0) + 1
    to = {a: min(of, key=lambda b: (-of[b], b != a, b or "")) for a, of in votes.items()}  # noqa: B023
    fits = lambda a, b: b is None if a is None else b is not None and to[a] == b
    return [w for w in windows if w["slots"] == w["doc_slots"] or all(map(fits, w["slots"], w["doc_slots"]))]


def chained(windows: list[dict]) -> list[dict]:
    """A longest run of windows that ascends in both texts."""
    windows = sorted(windows, key=lambda w: (w["at"], -w["place"], w["doc_slots"] != w["slots"]))
    return [windows[i] for i in longest_chain([w["place"] for w in windows])]


def verdict(windows: list[dict], n: int, size: int, rules: "Rules") -> tuple[int, int] | None:
    """Windows that count and slot values that are changed, if they show that the item is held: those that agree, chosen before
    or after the chain (a second copy nearby may be in it), or those equal word for word by themselves."""
    same = [w for w in windows if w["slots"] == w["doc_slots"]]
    for some in (lambda: chained(agreed(windows)), lambda: agreed(chained(windows)), lambda: chained(same)):
        chain = some()
        covered, words, upto = 0, [], 0
        for w in chain:
            a, b = max(upto, w["place"]), w["place"] + size
            words += w["slots"][a - w["place"] :]
            covered, upto = covered + b - a, b
        changed = len({a for w in chain for a, b in zip(w["slots"], w["doc_slots"]) if a != b})
        plain = sum(s is None for s in words)
        if covered >= rules.least_share * n and plain and (not changed or plain >= rules.least_template * len(words)):
            return len(chain), changed
        if len(same) == len(windows):
            break  # the other ways give the same
    return None


@dataclass(frozen=True)
class Rules:
    window: int = WINDOW
    least_share: float = 0.6  # of an item's canonical words that matched windows must cover
    least_template: float = 0.5  # of a re-parameterised passage's words that must not be placeholders


def items_of(benchmark: DataFrame, id_col: str, text_col: str, rules: Rules) -> DataFrame:
    """A row for each window of each item and reading: window, item, reading, place, size, n (canonical words), n_windows, slots of the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for k, c in enumerate(canonical([text])):
                    size = min(rules.window, len(c.hashes))
                    if not size or k and not c.other.any():
                        continue
                    h, _ = window_hashes(c.hashes, c.bounds, size)
                    out += [(int(x), item, k, i, size, len(c.hashes), len(h), c.slots(i, i + size)) for i, x in enumerate(h)]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=["window", "item", "reading", "place", "size", "n", "n_windows", "slots"])

    src = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    return mapped(src, run, "window long, item long, reading int, place int, size int, n int, n_windows int, slots array<string>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """A row for each document and item that it holds: doc, item, windows (of the item, matched), n_windows and changed
    (slot values that differ: 0 for a word-for-word copy).

    Windows match when their canonical words are equal in one of their readings. Those of an
    item are chained in ascending order in both texts, where the document may have up to
    half the item's words (16 at least) more or fewer. Windows that are equal word for word
    count by themselves. With changed values, each slot value of the item must stand for one
    value of the document (two may become one); a conflict costs the windows that hold it.
    What counts must cover least_share of the item's words. A passage needs a word outside placeholders, and one
    with changed values least_template of them. An item shorter than a window is one window
    of its length. Null ids and texts and texts without words hold nothing and are held by nothing. Repeated rows
    of a document, also with different texts, count as one. Texts are read whole, however long.
    Windows of documents are first sifted by a broadcast set of the benchmark's window hashes
    if it has at most SIFT of them; beyond that all windows go to the join.
    """
    spark = docs.sparkSession
    items = written(items_of(benchmark, item_id_col, item_text_col, rules), "items")
    lengths = sorted(int(r["size"]) for r in items.select("size").distinct().collect()) or [rules.window]  # at most `window` rows
    known = None
    if items.count() <= SIFT:
        hashes = np.unique(np.asarray(items.select("window").toArrow().column(0), np.int64))
        marks = np.zeros(1 << 24, bool)  # whether a hash with these 24 bits is known
        marks[hashes & (len(marks) - 1)] = True
        known = spark.sparkContext.broadcast((hashes, np.packbits(marks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, marks = known.value if known is not None else (None, None)
        lexicon = Lexicon()  # it goes with its task
        for batch in batches:
            for part, texts in pieces(batch, 1):
                docs, out = part.column(0).to_pylist(), []
                for _, c, size, h, at in readings(texts, lengths, lexicon):
                    if wanted is not None:
                        low = h & 0xFFFFFF
                        hit = np.flatnonzero(marks[low >> 3] & (np.uint8(128) >> (low & 7).astype(np.uint8)))
                        h, at = h[hit], at[hit]
                        near = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                        hit = np.flatnonzero(wanted[near] == h) if len(wanted) else near[:0]
                        h, at = h[hit], at[hit]
                    owner = np.searchsorted(c.bounds, at, "right") - 1
                    begin = c.first[np.minimum(c.bounds[owner], max(0, len(c.first) - 1))]
                    out += [(x, docs[o], i, c.slots(j, j + size)) for x, o, i, j in zip(h.tolist(), owner.tolist(), (c.first[at] - begin).tolist(), at.tolist())]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["window", "doc", "at", "doc_slots"])

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    found = mapped(source, run, "window long, doc long, at int, doc_slots array<string>")
    # Any chain lies in one of two bins of offsets, so that a group has some rows for each place of the item at most.
    offset = F.col("at") - F.col("place")
    drift = F.greatest(F.lit(DRIFT), F.floor(F.col("n") * DRIFT_SHARE))
    bins = F.array(2 * F.floor(offset / (2 * drift)), 2 * F.floor((offset + drift) / (2 * drift)) + 1)
    met = found.join(items, "window").withColumn("bin", F.explode(bins))
    aligned = met.groupBy("doc", "item", "reading", "bin").agg(F.max("n").alias("n"), F.max("n_windows").alias("n_windows"), F.max("size").alias("size"), F.collect_set(F.struct("at", "place", "slots", "doc_slots")).alias("windows"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, n, n_windows, size, windows in zip(*[c.to_pylist() for c in batch.columns]):
                found = verdict(windows, n, size, rules)
                if found:
                    out.append((doc, item, found[0], n_windows, found[1]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc", "item", "windows", "n_windows", "changed"])

    hits = mapped(aligned.select("doc", "item", "n", "n_windows", "size", "windows"), judge, "doc long, item long, windows int, n_windows int, changed int")
    best = hits.groupBy("doc", "item").agg(F.max(F.struct("windows", "n_windows", (-F.col("changed")).alias("same"))).alias("b"))
    return best.select("doc", "item", F.col("b.windows").alias("windows"), F.col("b.n_windows").alias("n_windows"), (-F.col("b.same")).alias("changed"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs' rows but for those that hold a benchmark item; rows with null ids stay."""
    out = few_to_all(written(contaminated(docs, benchmark, id_col, text_col, **options).select("doc").distinct(), "contaminated"))
    return docs.join(out, docs[id_col] == out["doc"], "left_anti")
