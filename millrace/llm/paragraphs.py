"""Substring dedup of paragraphs: MinHash bands find candidates, exact Jaccard decides, components are removed but for one.

A paragraph is a line of a text. Bands are tuned to a recall at the threshold; paragraphs
that collide in a band are compared through the bucket's hubs, and components of linked
paragraphs keep their first occurrence. What is left of a crowded bucket is dealt out again
by longer bands of the same recall.

A passage may also sit inside a longer paragraph, whose similarity it does not lift over the
threshold. So in what the removal of paragraphs leaves, stretches of STRETCH words are
paragraphs of their own kind: they start where the hash of three words is least among those
of some places in a row, which any PASSAGE words decide by themselves, so that two places
with a common passage of that length share a stretch. Each is carried on to both sides as
far as the words at its place and at its class's first place agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Recent, discard, few_to_all, mapped, pieces, written
from millrace.llm.links import ITEMS, described, linked_components, shared_buckets, stored_sets
from millrace.llm.shingles import runs, set_ids, sets, word_hashes, words

#: A decision of the removal, not of the search: like lines that are shorter, alone and with like ones next to them, are
#: reported by repeats() but stay in texts, which rightly share headings and notices.
LEAST_CUT = 40
#: Words of a stretch, and the length from which on a verbatim passage is sure to hold one.
STRETCH, PASSAGE = 32, 50
#: Rows of a band by which what is left of crowded buckets is dealt out again.
NARROW = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bands_for(percent: int, rows: int, recall: float = 0.999) -> int:
    """Bands of so many rows that find a pair at the threshold with this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - (percent / 100) ** rows)))


def tune_bands(percent: int, recall: float = 0.999, most_at_half: float = 0.17) -> tuple[int, int]:
    """Rows a band and bands: the fewest hashes' bands that find a pair at the threshold with this probability
    and a pair at half the threshold with at most the other."""
    found = []
    for r in range(1, 9):
        b = bands_for(percent, r, recall)
        if 1 - (1 - (percent / 200) ** r) ** b <= most_at_half:
            found.append((b * r, b, r))
    _, b, r = min(found)
    return r, b


def minhash_bands(h: np.ndarray, cut: np.ndarray, rows: int, bands: int, seed: int = 7) -> np.ndarray:
    """[set, band] hashes of so many minima each, by 32-bit linear maps of the items."""
    draw = np.random.default_rng(seed)
    short = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(cut) - 1, bands), np.uint64)
    for b in range(bands):
        total = np.full(len(cut) - 1, b + 1, np.uint64)
        for _ in range(rows):
            a, c = draw.integers(0, 1 << 32, 2, dtype=np.uint32)
            x = short * (a | np.uint32(1))
            x += c
            total = total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, cut[:-1])
        out[:, b] = total ^ (total >> np.uint64(29))
    return out.view(np.int64)


def long_lines(texts: list[bytes | None], min_words: int, k: int):
    """Shingle sets of lines with enough words: (h, cut, text of each line, number of each line in it, the same among lines with words, words of each)."""
    texts = [t or b"" for t in texts]
    h, _, feeds = word_hashes(texts)
    # Texts are joined by line feeds, so that a line's number in all texts tells its text.
    before = np.append(0, np.cumsum([t.count(b"\n") + 1 for t in texts]))
    first = np.flatnonzero(np.append(True, feeds[1:] != feeds[:-1])) if len(feeds) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(feeds)))
    owner = np.searchsorted(before, feeds[first], "right") - 1
    nth = np.arange(len(first)) - np.searchsorted(owner, owner)
    enough = size >= min_words
    if not enough.all():
        h, feeds = h[np.repeat(enough, size)], feeds[np.repeat(enough, size)]
    h, groups, cut = sets(h, feeds, k)
    owner = owner[enough]
    return h, cut, owner, groups - before[owner], nth[enough], size[enough]


def paragraphs(df: DataFrame, id_col: str, text_col: str, min_words: int, k: int, percent: int, rows: int, bands: int) -> DataFrame:
    """doc, line (from 0), nth (among lines with words), id (of the line's shingle set), n_words and sigs of each line with so many words.

    sigs: the set's bands; empty where the same set was met lately, and for sets so small that
    only equal ones, which are one class already, can be alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for part, texts in pieces(batch, 1):
                h, cut, owner, line, nth, words_ = long_lines(texts, min_words, k)
                ids, size = set_ids(h, cut), np.diff(cut)
                large = np.flatnonzero(100 * size >= percent * (size + 1))
                large = large[recent.fresh(ids[large])] if len(large) else large
                chosen = np.zeros(len(ids), bool)
                chosen[large] = True
                sig = np.empty((0, bands), np.int64)
                if len(large):
                    sig = minhash_bands(h[np.repeat(chosen, size)], np.append(0, np.cumsum(size[large])), rows, bands)
                ends = np.append(0, np.cumsum(chosen) * bands)
                sigs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(line, pa.int64()), pa.array(nth, pa.int64()), pa.array(ids), pa.array(words_, pa.int64()), sigs], names=["doc", "line", "nth", "id", "n_words", "sigs"])

    return mapped(df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), run, "doc long, line long, nth long, id long, n_words long, sigs array<long>")


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")


def similar_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 1, k: int = 5, percent: int = 80, recall: float = 0.999) -> DataFrame:
    """A row for each paragraph of min_words words or more that is alike another: doc, line, nth (the line's number among lines with
    words), n_words, class_doc and class_line (the component's first paragraph by document and line) and removed (it is not that first one).

    Alike are paragraphs whose sets of k-word shingles (A to Z lower-cased) have a Jaccard
    similarity of percent/100; equal sets are one class at once, and lines of fewer than k
    words are alike when all their words are equal. Null ids and texts, empty texts and blank
    lines give no row. Repeated rows of an id are one document: their like paragraphs are the
    same occurrence. Rows of one id with different texts have the paragraphs of both. Lines
    are read whole, however long.
    """
    source = _named(df, id_col, text_col)
    every = written(paragraphs(source, "doc", "text", min_words, k, percent, *tune_bands(percent, recall)), "paragraphs", "snappy")  # hashes don't get smaller
    bands = every.select(F.explode("sigs").alias("sig"), "id")
    every = every.drop("sigs")
    unique = source.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()  # else rows of repeated ids are shuffled to drop them
    own = every if unique else written(every.dropDuplicates(["doc", "line", "id"]), "own")
    classes = written(own.groupBy("id").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n")), "classes")

    def content(ids: DataFrame) -> DataFrame:
        first = classes.join(ids, "id").select("id", "first.doc", "first.line")
        wanted = few_to_all(written(first.groupBy("doc").agg(F.collect_list(F.struct("line", "id")).alias("lines")), "wanted"), items="lines")  # of one document

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in pieces(batch, 0):
                    ids, out = [], []
                    for text, some in zip(texts, part.column(1).to_pylist()):
                        lines = text.split(b"\n")
                        some = [x for x in some if x["line"] < len(lines)]  # rows of one id with different texts
                        ids += [x["id"] for x in some]
                        out += [lines[x["line"]] for x in some]
                    yield described(np.array(ids, np.int64), out, k)

        return mapped(source.join(wanted, "doc").select("text", "lines"), run, ITEMS)

    def narrower(sets_: DataFrame) -> DataFrame:
        many = bands_for(percent, NARROW, recall)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, values in pieces(batch, 1):
                    sig = minhash_bands(*stored_sets(values), NARROW, many, 11)
                    yield pa.RecordBatch.from_arrays([pa.array(sig.ravel()), pa.array(np.repeat(np.asarray(part.column(0)), many))], names=["sig", "id"])

        return mapped(sets_.select("id", "items"), run, "sig long, id long")

    buckets = shared_buckets(bands)
    joined = linked_components(buckets, content, percent, narrower, repeated=not unique)
    named = classes.join(joined, "id", "left").select("id", "first", "n", F.coalesce("component", "id").alias("c"))
    tops = written(named.groupBy("c").agg(F.min("first").alias("top"), F.sum("n").alias("total")).where("total > 1"), "tops")
    per_set = written(named.join(tops, "c").select("id", F.col("top.doc").alias("class_doc"), F.col("top.line").alias("class_line")), "sets")
    discard(classes, joined, tops)
    return own.join(few_to_all(per_set), "id").select("doc", "line", "nth", "n_words", "class_doc", "class_line", ((F.col("doc") != F.col("class_doc")) | (F.col("line") != F.col("class_line"))).alias("removed"))


def with_cuts(lines: DataFrame, least_cut: int) -> DataFrame:
    """lines of similar_paragraphs() with cut: whether the line goes, being removed and, together with removed lines next to it, of least_cut words or more."""
    by_doc = Window.partitionBy("doc").orderBy("nth")  # one document's lines
    gone = lines.where("removed").withColumn("__run", F.col("nth") - F.dense_rank().over(by_doc))
    total = F.sum("n_words").over(Window.partitionBy("doc", "__run"))
    gone = gone.withColumn("cut", total >= least_cut).drop("__run")
    return gone.unionByName(lines.where("NOT removed").withColumn("cut", F.lit(False)))


def stretch_starts(hashes: np.ndarray, segment: np.ndarray, size: int, passage: int) -> np.ndarray:
    """Words that stretches start at: of any passage - size + 1 places in a row in a segment, the one with the least hash of three words."""
    near = passage - size + 1
    key = runs(hashes, 3)
    n = len(hashes) - size + 1
    if n < near:
        return np.empty(0, np.int64)
    low = np.arange(n - near + 1)
    least = np.lib.stride_tricks.sliding_window_view(key[:n], near).argmin(1) + low
    whole = segment[low] == segment[low + near + size - 2]  # all those stretches are inside one segment
    return np.unique(least[whole])


def words_left(texts: list[bytes], gone: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words outside lines that go: their hashes, text, place in the text, and segment (no line that goes lies inside one)."""
    w = words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    place = np.arange(len(owner)) - w.bounds[owner]
    if not any(gone):
        return w.hashes, owner, place, owner
    before = np.append(0, np.cumsum([t.count(b"\n") + 1 for t in texts]))
    lines = np.array([before[i] + line for i, own in enumerate(gone) for line in own or []], np.int64)
    left = ~np.isin(w.feeds, lines)
    hashes, owner, place = w.hashes[left], owner[left], place[left]
    new = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)) if len(owner) else np.empty(0, bool)
    return hashes, owner, place, np.cumsum(new)


def repeated_spans(source: DataFrame, size: int = STRETCH, passage: int = PASSAGE, least: int = LEAST_CUT) -> DataFrame:
    """doc, at, to (words), class_doc, class_at and removed of verbatim passages that occur at two places or more.

    source: doc, text and gone (lines of the text that are left out, or null). Equal stretches
    are counted with partial sums; their least places are written, and all stretches are
    joined with them by hash, a join whose hot keys Spark can split. A stretch and its class's
    first place are carried on to both sides while their words agree; what has fewer than
    `least` words then is left alone. Both places are given, spans that overlap as one.
    """
    beside = passage - size  # words to either side that another stretch of a longer passage does not cover

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, 1):
                h, owner, place, segment = words_left(texts, part.column(2).to_pylist())
                at = stretch_starts(h, segment, size, passage)
                key = runs(h, size)[at] if len(at) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(owner[at])), pa.array(place[at].astype(np.int32))], names=["h", "doc", "at"])

    every = written(mapped(source.select("doc", "text", "gone"), cut, "h long, doc long, at int"), "stretches")
    firsts = every.groupBy("h").agg(F.min(F.struct("doc", "at")).alias("low"), F.max(F.struct("doc", "at")).alias("high")).where("low <> high")
    firsts = written(firsts.select("h", F.col("low.doc").alias("class_doc"), F.col("low.at").alias("class_at")), "firsts")
    found = written(every.join(firsts, "h").where("doc <> class_doc OR at <> class_at").select("doc", "at", "class_doc", "class_at").distinct(), "found")
    discard(every, firsts)

    # The words beside each place, from the texts of those documents alone.
    places = found.select("doc", "at").unionByName(found.select(F.col("class_doc").alias("doc"), F.col("class_at").alias("at")))
    asked = written(places.groupBy("doc").agg(F.collect_set("at").alias("places")), "places")  # of one document
    some = source.join(few_to_all(asked.select("doc")), "doc", "left_semi").join(asked, "doc")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, 1):
                h, owner, place, segment = words_left(texts, part.column(2).to_pylist())
                short, docs, out = (h >> np.uint64(32)).astype("<u4"), part.column(0).to_pylist(), ([], [], [], [])
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i, wanted in enumerate(part.column(3).to_pylist()):
                    low, high = edges[i], edges[i + 1]
                    for at in wanted:
                        j = low + int(np.searchsorted(place[low:high], at))
                        if j + size > high:
                            continue  # rows of one id with different texts
                        a, b = max(low, j - beside), min(high, j + size + beside)
                        left, right = short[a:j][segment[a:j] == segment[j]], short[j + size : b][segment[j + size : b] == segment[j]]
                        for o, v in zip(out, (docs[i], at, left.tobytes(), right.tobytes())):
                            o.append(v)
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=["doc", "at", "left", "right"])

    context = mapped(some.select("doc", "text", "gone", "places"), look, "doc long, at int, left binary, right binary")
    context = written(context.dropDuplicates(["doc", "at"]), "context")

    def agree(left: pa.Array, right: pa.Array, backwards: bool) -> np.ndarray:
        """How many words of both agree, from the last on or from the first on."""
        rows = [(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())]
        most = np.array([min(len(x), len(y)) // 4 for x, y in rows], np.int64)
        fill = (lambda v: v.rjust(4 * beside, b"\0")) if backwards else (lambda v: v.ljust(4 * beside, b"\0"))
        x, y = (np.frombuffer(b"".join([fill(r[j]) for r in rows]), "<u4").reshape(len(rows), beside) for j in range(2))
        same = x == y
        same = np.concatenate([same[:, ::-1] if backwards else same, np.zeros((len(rows), 1), bool)], axis=1)
        return np.minimum(same.argmin(1), most)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            before, after = agree(batch.column(4), batch.column(6), True), agree(batch.column(5), batch.column(7), False)
            doc, at, class_doc, class_at = (np.asarray(batch.column(j)) for j in range(4))
            good = before + size + after >= least
            own, first = (doc, at - before, at + size + after, class_doc, class_at - before), (class_doc, class_at - before, class_at + size + after, class_doc, class_at - before)
            cols = [np.concatenate([x[good], y[good]]) for x, y in zip(own, first)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            removed = pa.array(np.repeat([True, False], int(good.sum())))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), removed], names=["doc", "at", "to", "class_doc", "class_at", "removed"])

    ours = found.join(context, ["doc", "at"])
    theirs = context.select(F.col("doc").alias("class_doc"), F.col("at").alias("class_at"), F.col("left").alias("class_left"), F.col("right").alias("class_right"))
    both = ours.join(theirs, ["class_doc", "class_at"]).select("doc", "at", "class_doc", "class_at", "left", "right", "class_left", "class_right")
    spans = mapped(both, extend, "doc long, at int, to int, class_doc long, class_at int, removed boolean").distinct()
    spans = spans.repartition("doc").sortWithinPartitions("doc", "removed", "at")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "at", "to", "class_doc", "class_at", "removed"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        now = None
        for batch in batches:
            out = []
            for doc, at, to, class_doc, class_at, removed in zip(*[c.to_pylist() for c in batch.columns]):
                if now is not None and now[0] == doc and now[5] == removed and at <= now[2]:
                    now[2] = max(now[2], to)
                    now[3:5] = min((now[3], now[4]), (class_doc, class_at))
                else:
                    if now is not None:
                        out.append(now)
                    now = [doc, at, to, class_doc, class_at, removed]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now, kinds)], names=names)

    return mapped(spans, join, "doc long, at int, to int, class_doc long, class_at int, removed boolean")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 1, least_cut: int = LEAST_CUT, **options) -> DataFrame:
    """doc, kind (`line` or `stretch`), at (line, or first word), n_words, class_doc, class_at (the class's first place), removed
    (it is not that place) and cut (the removal takes it out).

    Like lines as in similar_paragraphs. A removed line is cut if it has, together with
    removed lines next to it, least_cut words or more. In what that leaves, passages of
    PASSAGE words or more that occur word for word (but for the case of A to Z) at another
    place are found whole, whatever stands around them, and many of least_cut words or more.
    A stretch is compared with its class's first place: a passage all of whose stretches have
    a first place that shares fewer than least_cut words with it is left.
    """
    source = _named(df, id_col, text_col)
    lines = written(with_cuts(similar_paragraphs(df, id_col, text_col, min_words=min_words, **options), least_cut), "lines")
    gone = written(lines.where("cut").groupBy("doc").agg(F.collect_set("line").alias("gone")), "gone")  # of one document
    spans = repeated_spans(source.join(few_to_all(gone, items="gone"), "doc", "left"), least=max(least_cut, STRETCH))
    lines = lines.select("doc", F.lit("line").alias("kind"), F.col("line").alias("at"), "n_words", "class_doc", F.col("class_line").alias("class_at"), "removed", "cut")
    spans = spans.select("doc", F.lit("stretch").alias("kind"), F.col("at").cast("long").alias("at"), (F.col("to") - F.col("at")).cast("long").alias("n_words"), "class_doc", F.col("class_at").cast("long").alias("class_at"), "removed", F.col("removed").alias("cut"))
    return lines.unionByName(spans)


def cuts(found: DataFrame) -> DataFrame:
    """Rows of repeats() that the removal takes out, and the first places of their classes, which stay."""
    classes = written(found.where("kind = 'line' AND cut").select("class_doc", "class_at").distinct(), "cut-classes")
    firsts = found.where("kind = 'line' AND NOT removed").join(classes, ["class_doc", "class_at"], "left_semi")
    return found.where("cut OR kind = 'stretch'").unionByName(firsts)


def cut_text(text: str, lines: set[int], spans: list[tuple[int, int]]) -> str:
    """text without these lines and without the words of these spans; lines that lose all their words go."""
    out, word, gone = [], 0, sorted(spans)
    for k, line in enumerate(text.split("\n")):
        places = [m.span() for m in _WORD.finditer(line)]
        mine = [(max(a, word) - word, min(b, word + len(places)) - word) for a, b in gone if a < word + len(places) and b > word]
        word += len(places)
        if k in lines:
            continue
        if mine:
            kept, low = [], 0
            for a, b in mine:
                kept.append(line[low : places[a][0]])
                low = places[b - 1][1]
            line = "".join([*kept, line[low:]])
            if not _WORD.search(line):
                continue
        out.append(line)
    return "\n".join(out)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", **options) -> DataFrame:
    """df's rows with repeated paragraphs and passages (those that repeats() says are cut) taken out of their texts, each class keeping its first one.

    count_col, where df has it, becomes the length of the text that is left in rows that were
    cut. A text all of whose lines go becomes empty. Rows with null ids or texts stay as they are.
    """
    found = repeats(df, id_col, text_col, **options).where("cut")
    cut = written(found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("kind", "at", "n_words")).alias("__gone")), "cut")  # of one document
    both = df.join(few_to_all(cut, items="__gone"), F.col(id_col) == F.col("__doc"), "left").drop("__doc")
    at = both.columns.index(text_col)
    count = both.columns.index(count_col) if count_col in df.columns else None
    kind = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.columns
            cuts = cols[-1].to_pylist()
            if any(cuts):
                texts = cols[at].to_pylist()
                for i, gone in enumerate(cuts):
                    if gone and texts[i] is not None:
                        texts[i] = cut_text(texts[i], {x["at"] for x in gone if x["kind"] == "line"}, [(x["at"], x["at"] + x["n_words"]) for x in gone if x["kind"] == "stretch"])
                cols[at] = pa.array(texts, pa.string())
                if count is not None:
                    cols[count] = pa.array([len(t) if gone and t is not None else n for t, gone, n in zip(texts, cuts, cols[count].to_pylist())], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols[:-1], names=kind.names)

    return mapped(both, run, T.StructType(kind.fields))
