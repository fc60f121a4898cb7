"""Exact Jaccard join of word-shingle sets by partitioning the universe of shingles.

Sets are in bands by size. Each band cuts the universe of shingles by hash into segments;
two sets that differ in at most H items agree exactly on one of H + 1 segments. A segment
may also be indexed with its one-deletion neighbourhood, which covers a difference of one
item and so counts for two. How many segments of either kind a band has is chosen by
estimated cost. A set is indexed under all its non-empty segments in its own band; as the
smaller set of a pair it probes, there and in the next band, no more segments than the
pigeonhole asks for, the fullest ones. All candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Recent, discard, few_to_all, mapped, mix64, pieces, written
from millrace.llm.links import ITEMS, described, linked_components, shared_buckets
from millrace.llm.shingles import set_ids, sets, word_hashes

EMPTY = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    differ: int  # items that two linked sets, the larger one in this band, differ in at most
    equal: int  # segments matched as they are
    deleted: int  # segments matched up to one deletion


def differ(n: int, m: int, percent: int) -> int:
    """Items that sets of n and m items with a Jaccard similarity of at least percent/100 differ in at most."""
    return (100 - percent) * (n + m) // (100 + percent)


def largest_partner(n: int, percent: int) -> int:
    return 100 * n // percent


def allocate(sets_in_band: float, size: int, most: int) -> tuple[int, int]:
    """Segments of either kind that cover a difference of `most` at the least estimated cost.

    A set costs a row for each plain segment and one more for each item of a segment with
    deletions. Two unrelated sets meet in a segment of g items each with probability
    exp(-2g), or exp(-2g) * (1 + 2g) with deletions; the hub of a bucket is compared with
    each member, so that a set in company costs a comparison, worth 20 rows.
    """
    need = most + 1 + (most + 1) // 12  # a few more than the pigeonhole asks for, as some are empty
    need += most > 0 and most < 12
    best = None
    for deleted in sorted({0, need // 8, need // 4, need // 2, (need + 1) // 2}):
        equal = max(0, need - 2 * deleted)
        g = size / max(1, equal + 2 * deleted)
        rows = equal + deleted * (1 + 2 * g)
        meet = 1 - np.exp(-min(50.0, sets_in_band * np.exp(-2 * g)))
        meet2 = 1 - np.exp(-min(50.0, sets_in_band * np.exp(-4 * g) * (1 + 4 * g)))
        cost = rows + 20 * (equal * meet * np.exp(-g) + deleted * meet2 * np.exp(-2 * g) * (1 + 2 * g))
        if best is None or cost < best[0]:
            best = cost, equal, deleted
    return best[1:]


def bands(largest: int, percent: int, counts: dict[int, int] | None = None, plan=allocate) -> list[Band]:
    """Bands of sizes up to the one after the largest set's; a set's larger partners are in its own band or the next."""
    out, low = [], 1
    while not out or out[-1].low <= largest:
        high = max(low, 10_000 * low // percent**2)
        most = differ(high, high, percent)
        number = sum(v for k, v in (counts or {}).items() if low <= k <= high)
        out.append(Band(low, high, most, *plan(number, (low + high) // 2, most)))
        low = high + 1
    return out


def band_of(n: np.ndarray, schemes: list[Band]) -> np.ndarray:
    return np.searchsorted([b.high for b in schemes], n, "left")


def signatures(h: np.ndarray, ident: int, scheme: Band, number: int, need: int, index: bool) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set in one band's scheme, and which of them probe.

    need: segments by the pigeonhole, difference + 1. index: all segments get a row, not only
    those that probe. A set with too few non-empty segments uses its empty ones too.
    """
    slots = scheme.equal + 2 * scheme.deleted
    salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    slot = ((mix64(h ^ salt) >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)
    segment = np.where(slot < scheme.equal, slot, scheme.equal + (slot - scheme.equal) // 2)
    count = scheme.equal + scheme.deleted
    value = mix64(h + salt)
    order = np.argsort(segment, kind="stable")
    filled, first = np.unique(segment[order], return_index=True)
    size = np.zeros(count, np.int64)
    size[filled] = np.diff(np.append(first, len(h)))
    total = np.zeros(count, np.uint64)
    total[filled] = np.add.reduceat(value[order], first)  # order-free, so that a deletion is a subtraction
    code = lambda seg, t: mix64(mix64(t ^ EMPTY) + (seg.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + salt)
    plain = np.flatnonzero(size[: scheme.equal])
    wanted = need - 2 * scheme.deleted
    if len(plain) < wanted:
        plain = np.arange(scheme.equal)
    picked = plain[np.argsort(-size[plain], kind="stable")[: max(0, wanted)]]
    probing = np.zeros(count, bool)
    probing[picked] = True
    use = plain if index else picked
    sig, probe = [code(use, total[use])], [probing[use]]
    if scheme.deleted:
        wide = np.arange(scheme.equal, count)
        inside = segment >= scheme.equal
        sig += [code(wide, total[wide]), code(segment[inside], total[segment[inside]] - value[inside])]
        probe += [np.ones(len(wide), bool), np.ones(int(inside.sum()), bool)]
    return np.concatenate(sig).view(np.int64), np.concatenate(probe)


def text_rows(texts: list[bytes | None], k: int, percent: int, schemes: list[Band], recent: Recent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sig, id and probe of the sets of some texts, leaving out sets that were met lately."""
    h, bounds, _ = word_hashes([t or b"" for t in texts])
    h, _, cut = sets(h, np.repeat(np.arange(len(texts)), np.diff(bounds)), k)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
    ids = set_ids(h, cut)
    for j in np.flatnonzero(recent.fresh(ids)).tolist():
        ident = int(ids[j])
        own = h[cut[j] : cut[j + 1]]
        n = len(own)
        b = int(band_of(n, schemes))
        partner = largest_partner(n, percent)
        for number in (b, b + 1):
            if number == b or partner > schemes[b].high:
                need = differ(n, min(partner, schemes[number].high), percent) + 1
                sig, probe = signatures(own, ident, schemes[number], number, need, number == b)
                out.append((sig, np.full(len(sig), ident), probe))
    return tuple(np.concatenate(x) for x in zip(*out))


def members(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc, id (of the shingle set; null for an empty one) and n, the set's size, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, 1):
                h, bounds, _ = word_hashes([t or b"" for t in texts])
                h, groups, cut = sets(h, np.repeat(np.arange(len(texts)), np.diff(bounds)), k)
                n, ident, has = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
                n[groups], ident[groups], has[groups] = np.diff(cut), set_ids(h, cut), True
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ident, mask=~has), pa.array(n)], names=["doc", "id", "n"])

    return mapped(df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), run, "doc long, id long, n long")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 3, percent: int = 90, plan=allocate) -> DataFrame:
    """doc, n_shingles and component_id (the least doc that links reach, itself included) of each row.

    Texts are lower-cased in A to Z; a set is the distinct k-word shingles, all words as one
    where there are fewer, and empty without words. Two rows are linked when
    100 * intersection >= percent * union; empty sets are linked with nothing, and rows with
    null ids neither (they get null as component). Rows with equal sets are one class, shown
    by their least id; repeated ids are one node. Repeated rows each come out.
    """
    own = written(members(df, id_col, text_col, k), "members")
    named = own.where("id IS NOT NULL AND doc IS NOT NULL")
    classes = written(named.groupBy("id").agg(F.min("doc").alias("least"), F.max("n").alias("n")), "classes")
    sizes = {r["power"]: r["c"] for r in classes.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("c")).collect()}  # a row for each power of two
    largest = classes.agg(F.max("n")).first()[0] or 0
    schemes = bands(largest, percent, {2 ** int(p) + 2 ** int(p) // 2: c for p, c in sizes.items()}, plan)
    source = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL")
    unique = named.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()  # else sets of repeated ids are shuffled to drop them

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, texts in pieces(batch, 0):
                sig, ident, probe = text_rows(texts, k, percent, schemes, recent)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ident), pa.array(probe)], names=["sig", "id", "probe"])

    def content(ids: DataFrame) -> DataFrame:
        wanted = few_to_all(written(classes.join(ids, "id").select("id", F.col("least").alias("doc")), "wanted"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in pieces(batch, 1):
                    yield described(np.asarray(part.column(0)), texts, k)

        return mapped(source.join(wanted, "doc").select("id", "text"), run, ITEMS)

    buckets = shared_buckets(mapped(source.select("text"), index, "sig long, id long, probe boolean"))
    joined = linked_components(buckets, content, percent, repeated=not unique)
    # Component ids of sets are hashes; documents want the least doc in the component.
    least = classes.join(joined, "id", "left").select("id", "least", F.coalesce("component", "id").alias("c"))
    top = written(least.groupBy("c").agg(F.min("least").alias("component_id")), "tops")
    per_set = written(least.join(top, "c").select("id", "component_id"), "sets")
    discard(classes, joined, top)
    found = own.join(per_set, "id", "left")
    return found.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNull(), None).otherwise(F.coalesce("component_id", "doc")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """df's rows but for those whose component holds a row with a lesser id; rows with a null id or no words all stay.

    Of repeated rows of the id that stays, all stay.
    """
    found = similar_components(df, id_col, text_col, k=k, percent=percent)
    out = few_to_all(written(found.where("doc <> component_id").select("doc").distinct(), "repeats"))
    return df.join(out, df[id_col] == out["doc"], "left_anti")
