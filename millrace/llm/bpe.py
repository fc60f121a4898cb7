"""Byte-level BPE by a file of ranks: boundaries without regex, merges from a cache, and decoding.

The split pattern is a finite-state transducer over codepoint classes. Its transition
functions compose associatively, so a batch of texts is cut into chunks whose composed
functions are found side by side, chained over chunks, and replayed from the known states.
A null text is an empty one: no tokens.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import with_columns

# Codepoint classes. Letters that end a contraction have classes of their own.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, STOP = range(7)
#: Code points with the Unicode property White_Space, but for the space itself.
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe at the start of a match.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

# States: what the last match may still take in.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, OWES_1, OWES_2 = range(8)
STATES = 8
CHUNK = 128


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE], table[0x20], table[ord("'")] = WHITE, SPACE, QUOTE
    return table


@functools.cache
def transitions() -> np.ndarray:
    """[symbol, state] -> next state + 8 if a match starts at the symbol.

    Symbols: 0 letter, 1 number, 2 other, 3 the space before a non-space, 4 other white space
    before a non-space, 5 white space before white space or the end, 6 and 7 an apostrophe
    with a contraction of two and of three characters.
    """
    table = np.zeros((8, STATES), np.uint8)
    for state in range(STATES):
        for symbol in range(8):
            if state == OWES_2 or state == OWES_1:
                table[symbol, state] = OWES_1 if state == OWES_2 else FRESH
            elif symbol <= 2:
                run = (IN_LETTERS, IN_NUMBERS, IN_OTHER)[symbol]
                table[symbol, state] = run if state in (run, AFTER_SPACE) else run + 8
            elif symbol == 3:
                table[symbol, state] = AFTER_SPACE + 8
            elif symbol == 4:
                table[symbol, state] = FRESH + 8
            elif symbol == 5:
                table[symbol, state] = IN_WHITE if state == IN_WHITE else IN_WHITE + 8
            else:
                table[symbol, state] = IN_OTHER if state in (IN_OTHER, AFTER_SPACE) else (OWES_1 if symbol == 6 else OWES_2) + 8
    return table


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each character of several texts laid end to end; ends: where each text ends."""
    kind = classes()[codes]
    following = np.append(kind[1:], STOP)
    full = ends[ends > 0]
    following[full - 1] = STOP  # nothing is seen beyond a text's end
    blank = (kind == SPACE) | (kind == WHITE)
    before_solid = (following < SPACE) | (following == QUOTE)
    out = np.where(kind == QUOTE, np.uint8(OTHER), kind)
    out[blank] = 5
    out[(kind == SPACE) & before_solid] = 3
    out[(kind == WHITE) & before_solid] = 4
    at = np.flatnonzero(kind == QUOTE)
    if len(at):
        limit = ends[np.searchsorted(ends, at, "right")]
        one = np.where(at + 1 < limit, codes[np.minimum(at + 1, len(codes) - 1)], 0)
        two = np.where(at + 2 < limit, codes[np.minimum(at + 2, len(codes) - 1)], 0)
        for c in CONTRACTIONS:
            out[at[(one == ord(c[0])) if len(c) == 1 else (one == ord(c[0])) & (two == ord(c[1]))]] = 5 + len(c)
    return out


def starts_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where matches start in several texts laid end to end."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.int64)
    table, sym = transitions(), symbols(codes, ends)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, 5, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    text_start = np.zeros(rows * CHUNK, bool)
    text_start[np.append(0, ends[:-1])[np.append(0, ends[:-1]) < n]] = True
    text_start = np.ascontiguousarray(text_start.reshape(rows, CHUNK).T)
    fresh_rows = [np.flatnonzero(text_start[k]) for k in range(CHUNK)]
    flat = (table & 7).ravel()
    # Each chunk's transition function, all chunks side by side.
    reach = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for k in range(CHUNK):
        if len(fresh_rows[k]):
            reach[fresh_rows[k]] = FRESH
        reach = flat[(grid[k] * np.uint8(STATES))[:, None] + reach]
    # Composition over chunks: by doubling, as the functions compose associatively.
    whole, step = reach, 1
    while step < rows:
        late = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)
        whole = np.concatenate([whole[:step], late])
        step *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = FRESH, whole[:-1, FRESH]
    # Replay from the known states.
    start = np.empty((CHUNK, rows), bool)
    flat = table.ravel()
    for k in range(CHUNK):
        if len(fresh_rows[k]):
            state[fresh_rows[k]] = FRESH
        move = flat[grid[k] * np.uint8(STATES) + state]
        start[k] = move >= 8
        state = move & 7
    return np.flatnonzero(start.T.ravel()[:n])


@functools.cache
def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


@functools.cache
def pair_table(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """An open-addressing table from pairs of ids to the id of their merge, the ids of single bytes, and its bits.

    A merge's id is its rank. Every way to cut a token into two tokens is a pair.
    """
    ranks = ranks_of(content)
    left, right, into = [], [], []
    for word, rank in ranks.items():
        for cut in range(1, len(word)):
            a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), into.append(rank)
    keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
    values, bits = np.array(into, np.int64), max(8, int(np.ceil(np.log2(len(keys) + 1))) + 2)
    table, found = np.full(1 << bits, NO_PAIR, np.uint64), np.full(1 << bits, NO_MERGE, np.int64)
    slots, todo = _slot(keys, bits), np.arange(len(keys))
    while len(todo):  # each round the first claimant of a free slot gets it, the others go one slot on
        free = todo[table[slots[todo]] == NO_PAIR]
        got = free[np.unique(slots[free], return_index=True)[1]]
        table[slots[got]], found[slots[got]] = keys[got], values[got]
        todo = np.setdiff1d(todo, got, assume_unique=True)
        slots[todo] = (slots[todo] + 1) & ((1 << bits) - 1)
    return table, found, np.array([ranks[bytes([c])] for c in range(256)], np.int64), bits


NO_PAIR, NO_MERGE = np.uint64((1 << 64) - 1), np.int64(1 << 40)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _merge_ids(left: np.ndarray, right: np.ndarray, pairs) -> np.ndarray:
    table, found, _, bits = pairs
    keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    slots = _slot(keys, bits)
    seen = table[slots]
    out = np.where(seen == keys, found[slots], NO_MERGE)
    open_ = np.flatnonzero((seen != keys) & (seen != NO_PAIR))
    while len(open_):
        slots[open_] = (slots[open_] + 1) & ((1 << bits) - 1)
        seen = table[slots[open_]]
        hit = seen == keys[open_]
        out[open_[hit]] = found[slots[open_[hit]]]
        open_ = open_[~hit & (seen != NO_PAIR)]
    return out


def merge_all(pieces: list[bytes], content: bytes) -> list[np.ndarray]:
    """Ids of many matches at once: in each round every match merges its leftmost pair of lowest rank."""
    pairs, ranks = pair_table(content), ranks_of(content)
    out: list = [None] * len(pieces)
    work = []
    for k, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is None and piece:
            work.append(k)
        else:
            out[k] = np.array([whole] if piece else [], np.uint32)
    if not work:
        return out
    sizes = np.array([len(pieces[k]) for k in work], np.int64)
    ids = pairs[2][np.frombuffer(b"".join([pieces[k] for k in work]), np.uint8)]
    owner = np.arange(len(work))  # which match each run of symbols is
    first = np.append(0, np.cumsum(sizes)[:-1])
    merge = np.full(len(ids), NO_MERGE, np.int64)
    merge[:-1] = _merge_ids(ids[:-1], ids[1:], pairs)
    merge[first + sizes - 1] = NO_MERGE
    while len(owner):
        low = np.minimum.reduceat(merge, first)
        done = low == NO_MERGE
        if done.any():
            for w, a, n in zip(owner[done].tolist(), first[done].tolist(), sizes[done].tolist()):
                out[work[w]] = ids[a : a + n].astype(np.uint32)
            stay = np.repeat(~done, sizes)
            ids, merge, owner, sizes, low = ids[stay], merge[stay], owner[~done], sizes[~done], low[~done]
            if not len(owner):
                break
            first = np.append(0, np.cumsum(sizes)[:-1])
        at = np.flatnonzero(merge == np.repeat(low, sizes))
        run = np.searchsorted(first, at, "right") - 1
        at = at[np.append(True, run[1:] != run[:-1])]  # one merge in each match
        ids[at] = low
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        merge[at] = merge[at + 1]  # whether the match ends here; the rest is looked up below
        ids, merge, sizes = ids[keep], merge[keep], sizes - 1
        at = at - np.arange(len(at))
        first = np.append(0, np.cumsum(sizes)[:-1])
        last = first + sizes - 1
        right = at[at < last]
        merge[at[at == last]] = NO_MERGE
        merge[right] = _merge_ids(ids[right], ids[right + 1], pairs)
        before = at[at > first] - 1
        merge[before] = _merge_ids(ids[before], ids[before + 1], pairs)
    return out


class Merges:
    """match -> its ids as little-endian 32-bit numbers, in two generations of bounded size: what a full
    generation has not used again is forgotten."""

    def __init__(self, content: bytes, most: int = 100_000):
        self.content, self.most, self.new, self.old = content, most, {}, {}

    def __call__(self, matches: list[str]) -> list[bytes]:
        new, old = self.new, self.old
        missing = [m for m in set(matches) if m not in new]
        if missing:
            if len(new) + len(missing) > self.most:
                self.old = old = new
                self.new = new = {}
                missing = list(set(matches))
            unknown = []
            for m in missing:
                if m in old:
                    new[m] = old[m]
                else:
                    unknown.append(m)
            if unknown:
                new.update(zip(unknown, [x.tobytes() for x in merge_all([m.encode("utf-8", "surrogatepass") for m in unknown], self.content)]))
        return [new[m] for m in matches]


@functools.cache
def words_of(content: bytes) -> list[bytes]:
    ranks = ranks_of(content)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, i in ranks.items():
        out[i] = word
    return out


def split(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the starts and ends, in characters, of its matches."""
    ends = np.cumsum([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = starts_of(codes, ends)
    cut = np.searchsorted(starts, np.append(0, ends))
    out = []
    for k, base in enumerate(np.append(0, ends[:-1]) if len(ends) else []):
        own = starts[cut[k] : cut[k + 1]] - base
        out.append((own, np.append(own[1:], len(texts[k])) if len(own) else own))
    return out


FIELDS = [
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType())),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
]


@functools.cache
def _bytes_tables(content: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For decoding and for decimal text: the bytes of every id end to end, where they start and how many they are."""
    words = words_of(content)
    out = []
    for parts in (words, [b"%d," % i for i in range(len(words))]):
        sizes = np.array([len(p) for p in parts], np.int64)
        out.append((np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum(sizes)[:-1]), sizes))
    return out


def spelled(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The bytes that a table has for ids, end to end."""
    data, starts, sizes = table
    n = sizes[ids]
    ends = np.cumsum(n)
    return data[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _encode(content: bytes, tokens: bool):
    def make():
        cache, (words, decimals) = Merges(content), _bytes_tables(content)  # the cache goes with its task

        def call(texts):
            texts = ["" if t is None else t.decode("utf-8", "replace") for t in texts]
            cuts = split(texts)
            matches = [text[a:b] for text, (starts, ends) in zip(texts, cuts) for a, b in zip(starts.tolist(), ends.tolist())]
            found = cache(matches)
            n_tokens, sha, decoded, all_ids, all_offsets, at = [], [], [], [], [], 0
            for starts, _ in cuts:
                ids = np.frombuffer(b"".join(found[at : at + len(starts)]), np.uint32)
                at += len(starts)
                n_tokens.append(len(ids))
                sha.append(hashlib.sha256(spelled(ids, decimals)[:-1]).hexdigest())
                decoded.append(hashlib.sha256(spelled(ids, words)).hexdigest())
                if tokens:
                    all_ids.append(ids.astype(np.int32))
                    all_offsets.append(np.append(0, np.cumsum(words[2][ids])).astype(np.int32))
            kinds = pa.list_(pa.int32())
            more = [pa.array(all_ids, kinds), pa.array(all_offsets, kinds)] if tokens else []
            return [*more, pa.array(n_tokens, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string())]

        return call

    return make


def encode(df: DataFrame, ranks: bytes, text_col: str = "text", keep: list[str] | None = None, tokens: bool = True) -> DataFrame:
    """Adds ids, their byte offsets (one more than ids), n_tokens and digests of the ids and of the decoded bytes.

    ranks: the content of a file of base64 tokens and ranks; it must hold all 256 single bytes.
    tokens=False leaves the arrays out. Null and empty texts have no tokens, offset 0 only and
    the digests of nothing. Special tokens' strings are ordinary text. Repeated rows are
    encoded each on its own. Columns of df named like a result give way to it. The decoded
    bytes are built from the ids alone.
    """
    return with_columns(df, text_col, FIELDS if tokens else FIELDS[2:], _encode(ranks, tokens), keep)


def decode_ids(ids: list[int], ranks: bytes, offsets: list[int] | None = None, first: int = 0, last: int | None = None) -> bytes:
    """The bytes of ids; with offsets, of the tokens that overlap bytes first to last only."""
    vocabulary = words_of(ranks)
    if offsets is not None:
        low = max(0, int(np.searchsorted(offsets, first, "right")) - 1)
        high = len(ids) if last is None else int(np.searchsorted(offsets[:-1], last, "left"))
        ids = ids[low:high]
    return b"".join(vocabulary[i] for i in ids)


def decode(df: DataFrame, ranks: bytes, ids_col: str = "ids", name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the bytes of an array of ids as text (invalid UTF-8 replaced); null ids give null."""
    from pyspark.sql import functions as F

    @F.pandas_udf(T.StringType())
    def text(ids):
        vocabulary = words_of(ranks)
        return ids.map(lambda x: None if x is None else b"".join([vocabulary[i] for i in x]).decode("utf-8", "replace"))

    base = df if keep is None else df.select(*keep, ids_col)
    return base.withColumn(name, text(base[ids_col]))
