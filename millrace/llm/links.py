"""From buckets of similar items to components, without writing out all pairs of a bucket.

A bucket's members are first compared with one member of it, the hub. What is linked is
contracted to components, and buckets whose members are all of one component are done. What
is left may be dealt into narrower buckets by longer keys, at any size alike. While its pairs
are many more than its rows, it gets other hubs each round: the member that shares the most
places with others, which is the centre where copies of one original were each changed, and
ones at random. Last, pairs of different components in a bucket are compared.

An exact bound on the difference of two sets, from narrow sketches, is asked before any set
itself is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, mapped, pieces, written
from millrace.llm.shingles import common, set_ids, sets, word_hashes

FIRST = 12  # buckets of a set that are looked at to take a pair once
ROUNDS = 3  # of narrower buckets and hubs, at most
#: Pairs in buckets, in all or for each row, that are compared without more rounds: a round shuffles every row some times,
#: which costs as much as some dozen comparisons of sketches.
FEW_PAIRS, FEW_PER_ROW = 1_000_000, 50
WORDS = 8  # of 64 bits in a parity sketch
SKETCH = ["n", *(f"s{k}" for k in range(WORDS))]
ITEMS = "id long, " + ", ".join(f"{c} long" for c in SKETCH) + ", items binary"


def sketches(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """[set, word] parity sketches: each item flips one of 512 bits, so that two sketches differ in at most as many bits as their sets in items."""
    out = np.zeros((len(cut) - 1) * WORDS * 64, np.uint8)
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    np.bitwise_xor.at(out, owner * (WORDS * 64) + ((h >> np.uint64(20)) % np.uint64(WORDS * 64)).astype(np.int64), np.uint8(1))
    return np.packbits(out.reshape(-1, WORDS * 64), axis=1, bitorder="little").view(np.int64)


def described(wanted: np.ndarray, values: list[bytes | None], k: int) -> pa.RecordBatch:
    """ITEMS of some texts: id, n, sketch and sorted items (64-bit hashes) of the k-word shingle set of each; a text whose set has not the id wanted is left out."""
    h, bounds, _ = word_hashes([v or b"" for v in values])
    h, groups, cut = sets(h, np.repeat(np.arange(len(values)), np.diff(bounds)), k)
    ids = set_ids(h, cut)
    good = np.flatnonzero(ids == wanted[groups])
    marks, raw = sketches(h, cut)[good], h.astype("<u8").tobytes()
    items = pa.array([raw[8 * a : 8 * b] for a, b in zip(cut[good].tolist(), cut[good + 1].tolist())], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(np.diff(cut)[good]), *(pa.array(marks[:, j]) for j in range(WORDS)), items], names=["id", *SKETCH, "items"])


def stored_sets(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Items of several stored sets end to end, and their bounds."""
    return np.frombuffer(b"".join(values), "<u8").astype(np.uint64), np.append(0, np.cumsum([len(v) // 8 for v in values]))


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """id and component (the least id that links reach) of every id in edges a, b.

    Each round every id takes its least neighbour, and that one's, and the edges between what
    results are carried on. Only minima are gathered for an id, whatever its degree.
    """
    edges = written(edges.select("a", "b").where("a <> b"), name)
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        up = to.select(F.col("id").alias("to"), F.col("to").alias("up"))
        rounds.append(written(to.join(up, "to").select("id", F.col("up").alias("to")), "parents"))
        x, y = (rounds[-1].select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        rest = written(edges.join(x, "a").join(y, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), name)
        discard(edges)
        edges = rest
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))  # no rows
    found = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("id").alias("to"), F.col("to").alias("up"))
        found = found.join(up, "to", "left").select("id", F.coalesce("up", "to").alias("to"))
    return found.select("id", F.col("to").alias("component"))


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows sig, id, probe (without that column: all probe) of buckets that have two different ids or more and a probe, with the bucket's
    least probing id as hub, and `more`: whether another id probes too (if not, pairs with the hub are all that matter).

    Rows are sorted by bucket on disk if need be and streamed: a task holds one batch, and
    for a bucket its hub, its first row and whether a probe was seen.
    """
    some = "probe" in rows.columns
    rows = rows.repartition("sig").sortWithinPartitions("sig", *([F.col("probe").desc()] if some else []), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "id", "hub", "probe", "more"])

        def shared(sig, ids, probe, unsure=False):
            first = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.empty(0, bool)
            start = np.flatnonzero(first)
            sizes = np.diff(np.append(start, len(sig)))
            different = np.maximum.reduceat(ids, start) != np.minimum.reduceat(ids, start)
            good = np.repeat(different & probe[start], sizes)
            # The first row of a bucket is a probe; the least id among its probes is the hub.
            hub = np.repeat(ids[start], sizes)
            more = np.repeat(np.logical_or.reduceat(probe & (ids != hub), start), sizes)
            if unsure and len(start):  # the last bucket goes on, perhaps with probes
                more[start[-1] :] = True
            return rows_of(sig[good], ids[good], hub[good], probe[good], more[good])

        hold = None  # rows of the last bucket; once it is known to be shared only its hub row stays
        open_hub = None
        for batch in batches:
            sig, ids = (np.asarray(batch.column(k)) for k in range(2))
            probe = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool) if some else np.ones(len(sig), bool)
            if open_hub is not None:  # the bucket that goes on from the last batch
                n = int(np.searchsorted(sig, open_hub[0], "right"))
                yield rows_of(sig[:n], ids[:n], np.full(n, open_hub[1]), probe[:n], np.full(n, open_hub[2]))
                sig, ids, probe = sig[n:], ids[n:], probe[n:]
                if not len(sig):
                    continue
                open_hub = None
            if hold is not None:
                sig, ids, probe = (np.concatenate(x) for x in zip(hold, (sig, ids, probe)))
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1], "left"))
            if last:
                yield shared(sig[:last], ids[:last], probe[:last])
            hold = (sig[last:], ids[last:], probe[last:])
            if not hold[2][0]:  # no probe: nothing of it is needed, but its sig must be passed over
                hold = tuple(x[:1] for x in hold)
            elif hold[1].max() != hold[1].min():
                unsure = bool(hold[2][-1])
                yield shared(*hold, unsure)
                open_hub, hold = (hold[0][0], hold[1][0], unsure or bool((hold[2] & (hold[1] != hold[1][0])).any())), None
            else:
                hold = tuple(x[:1] for x in hold)
        if hold is not None and len(hold[0]):
            yield shared(*hold)

    return mapped(rows, run, "sig long, id long, hub long, probe boolean, more boolean")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in pieces(batch, 2):
                good = []
                for a, b in zip(left, part.column(3).to_pylist()):
                    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                    shared = common(x, y)
                    good.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def linked_components(buckets: DataFrame, content: Callable[[DataFrame], DataFrame], percent: int, rekey: Callable[[DataFrame], DataFrame] | None = None, repeated: bool = False) -> DataFrame:
    """id and component of all ids that a link joins to another: a Jaccard similarity of percent/100 of their sets.

    buckets: sig, id, hub, from shared_buckets. content(ids): ITEMS of these ids.
    rekey(sets of ITEMS): sig and id of narrower buckets, in which linked sets still meet.
    repeated: content() may give an id twice.
    """
    buckets = written(buckets, "buckets")
    items = content(buckets.select("id").distinct())
    items = written(items.dropDuplicates(["id"]) if repeated else items, "items")

    def close(side_a: str = "a", side_b: str = "b") -> Column:
        n, m = F.col(f"n_{side_a}"), F.col(f"n_{side_b}")
        most = F.floor((100 - percent) * (n + m) / (100 + percent))
        apart = sum(F.bit_count(F.col(f"{c}_{side_a}").bitwiseXOR(F.col(f"{c}_{side_b}"))) for c in SKETCH[1:])
        return (F.abs(n - m) <= most) & (apart <= most)

    def side(x: str, *columns: str) -> DataFrame:
        return items.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    def tested(pairs: DataFrame, sifted: bool = False) -> DataFrame:
        """a, b: the components of linked pairs of rows a, b, c_a, c_b."""
        if not sifted:
            pairs = pairs.join(side("a", *SKETCH), "a").join(side("b", *SKETCH, "items"), "b").where(close())
        else:
            pairs = pairs.join(side("b", "items"), "b")
        both = pairs.select("a", "c_a", "c_b", "items_b").join(side("a", "items"), "a")
        return mapped(both.select("c_a", "c_b", "items_a", "items_b"), _verify(percent), "a long, b long")

    def open_rows(rows: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
        """sig, id, component of buckets with more than one component, and for each such bucket its largest component, its rows and the
        pairs of rows of different components, one of which probes. to: the components of ids; others are their own."""
        named = rows.select("sig", "id", "probe").join(to, "id", "left").select("sig", "id", "probe", F.coalesce("component", "id").alias("component"))
        by = named.groupBy("sig", "component").agg(F.count(F.lit(1)).cast("double").alias("c"), F.count_if("probe").alias("p"))
        mixed = by.groupBy("sig").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
        mixed = written(mixed.select("sig", "top", "n", F.least((F.col("n") * F.col("n") - F.col("q")) / 2, F.col("p") * F.col("n")).alias("pairs")), "mixed")
        return written(named.join(mixed.select("sig"), "sig", "left_semi"), "open"), mixed

    def joined(done: DataFrame, new: DataFrame) -> DataFrame:
        """done, and what new says of components and of ids that are their own component."""
        up = new.select(F.col("id").alias("component"), F.col("component").alias("up"))
        moved = done.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        return written(moved.unionByName(new.join(done, "id", "left_anti")), "components")

    def crowded(mixed: DataFrame) -> bool:
        rows, pairs = mixed.agg(F.sum("n"), F.sum("pairs")).first()
        return (pairs or 0) > max(FEW_PAIRS, FEW_PER_ROW * (rows or 0))

    pairs = buckets.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("id").alias("c_a"), F.col("hub").alias("c_b")).distinct()
    done = written(components(tested(pairs)), "components")
    rest, mixed = open_rows(buckets.where("more"), done)
    discard(buckets)
    if rekey is not None and not rest.isEmpty():
        old = rest
        rows = written(shared_buckets(rekey(items.join(rest.select("id").distinct(), "id"))).select("sig", "id", "probe"), "narrow")
        rest, mixed = open_rows(rows, done)
        discard(old, rows)
    for turn in range(ROUNDS):
        if not crowded(mixed):
            break
        own, rows = F.struct("id", "component"), rest
        picked = F.max_by(own, F.xxhash64("id", F.lit(turn)))
        if turn == 0:
            rows = rest.join(rest.join(mixed.select("sig", "n"), "sig").groupBy("id").agg(F.sum("n").alias("crowd")), "id")
            picked = F.max_by(own, F.struct("crowd", "id"))
        hubs = rows.where("probe").groupBy("sig").agg(picked.alias("hub"))
        pairs = rest.join(hubs, "sig").where("component <> hub.component")
        pairs = pairs.select(F.col("id").alias("a"), F.col("hub.id").alias("b"), F.col("component").alias("c_a"), F.col("hub.component").alias("c_b")).distinct()
        new = written(components(tested(pairs)), "new")
        if new.isEmpty():
            break
        done, old = joined(done, new), rest
        rest, mixed = open_rows(rest, done)
        discard(old)
    if not rest.isEmpty():
        every = rest.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST).alias("sigs"))  # of one set
        marked = rest.join(items.select("id", *SKETCH).join(every, "id"), "id")
        half = lambda x: marked.select("sig", F.col("sigs").alias(f"sigs_{x}"), F.col("id").alias(x), F.col("component").alias(f"c_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in SKETCH])
        # A bucket's largest component is on one side only: few rows beside a large one make few pairs.
        outside = half("a").join(mixed.select("sig", "top"), "sig").where("c_a <> top")
        pairs = outside.join(half("b"), "sig").where((F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("top")) | (F.col("a") < F.col("b"))) & close())
        # Of buckets that a pair shares among the first ones of both, it is taken from the first only.
        pairs = pairs.where(F.coalesce(F.col("sig") <= F.array_min(F.array_intersect("sigs_a", "sigs_b")), F.lit(True)))
        new = written(components(tested(pairs.select("a", "b", "c_a", "c_b").distinct(), sifted=True)), "new")
        if not new.isEmpty():
            done = joined(done, new)
    discard(items, rest)
    return done
