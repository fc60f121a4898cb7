"""Ranked lexical search: a term at a time, the rarest first, with a limit to the accumulators.

The documents are dealt into blocks; each has an inverted file of the terms that queries
hold, written once. Weights come from counts over all documents. Within a block a query's
terms are taken from the rarest on. Each adds to the accumulators of its documents; once what
the remaining terms can add at most is less than the k-th best partial score (of the block,
or of the blocks before it in the task), no accumulator is made any more, and those there are
go on to be exact. What is left out thereby has k better ones, so the ranking is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, mapped, pieces, written
from millrace.llm.shingles import words

#: Lower-cases A to Z and makes every other ASCII character but digits and letters a space.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Documents and postings of a block; a block is closed by the first that is reached.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
#: Queries that one pass over the index takes; more are taken in several passes.
QUERIES_A_PASS = 2000
BLOCKS = "docs array<long>, lengths binary, terms array<int>, dfs array<int>, at binary, tf binary, n_docs long, n_terms long"


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every term of the texts in order, and the bound of each text's terms."""
    found = words([t.translate(TERMS) for t in texts], lower=False)
    return found.hashes, found.bounds


def read_queries(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = QUERIES_A_PASS) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Lists of at most about `most` queries: id and hashes of its distinct terms. Texts of a repeated id are one query."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    passes = max(1, -(-rows.count() // most))
    for k in range(passes):
        own: dict[int | None, list[bytes]] = {}
        for item, text in rows.where(F.pmod(F.coalesce(F.xxhash64("item"), F.lit(0)), F.lit(passes)) == k).collect():
            own.setdefault(item, []).append((text or "").encode())
        yield [(item, np.unique(terms_of(texts)[0])) for item, texts in own.items()]


def index_blocks(docs: DataFrame, wanted: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An inverted file for each block of documents. wanted: sorted hashes of the terms that get postings; a term is its place there.

    docs and lengths (terms with repeats) of the block; its terms in order with their numbers
    of documents, and for these one after another the documents' places (at) and tf.
    n_docs: documents with a term; n_terms: all their terms with repeats.
    """

    def block(ids: list, lengths: list, keys: list, counts: list) -> pa.RecordBatch:
        doc, n, key, tf = pa.concat_arrays(ids), np.concatenate(lengths), np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")  # by term, then by place
        key, tf = key[order], tf[order]
        term = key >> 32
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
        own, many, few = np.diff(np.append(first, len(term))), pa.list_(pa.int64()), pa.list_(pa.int32())
        cols = [
            pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc).cast(many), pa.array([n.astype("<i8").tobytes()]), pa.array([term[first].astype(np.int32)], few), pa.array([own.astype(np.int32)], few),
            pa.array([(key & 0xFFFFFFFF).astype("<i4").tobytes()]), pa.array([tf.astype("<i4").tobytes()]), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_postings = ([], [], [], []), 0, 0
        for batch in batches:
            for part, texts in pieces(batch, 1):
                h, bounds = terms_of([t or b"" for t in texts])
                place = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                known = np.flatnonzero(wanted[place] == h) if len(wanted) else np.empty(0, np.int64)
                owner = np.searchsorted(bounds, known, "right") - 1 + n_docs
                key, tf = np.unique((place[known].astype(np.int64) << 32) | owner, return_counts=True)
                for to, new in zip(held, (part.column(0), np.diff(bounds), key, tf)):
                    to.append(new)
                n_docs, n_postings = n_docs + len(texts), n_postings + len(key)
                if n_docs >= BLOCK_DOCS or n_postings >= BLOCK_POSTINGS:
                    yield block(*held)
                    held, n_docs, n_postings = ([], [], [], []), 0, 0
        if n_docs:
            yield block(*held)

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, BLOCKS)


class Best:
    """The k best documents of a query so far: by score, equal ones by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """A score below which nothing can enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.append(x, y) for x, y in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def kth_largest(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def accumulate(terms: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, k: int, least: int) -> np.ndarray:
    """Scores of a block's documents for one query. terms: documents' places, what each gets, and the most that one gets, the rarest term first.

    Exact for every document that can be among the k best with a score of `least` or more; others may lack some terms, or all.
    """
    acc = np.zeros(n_docs, np.int64)
    left = sum(most for _, _, most in terms)
    for j, (at, gain, most) in enumerate(terms):
        # An unseen document gets `left` at most: not if that is under the k-th best partial score.
        if left < least or (j and left < acc.max() and left < kth_largest(acc, k)):
            for at, gain, _ in terms[j:]:
                acc[at] += np.where(acc[at] > 0, gain, 0)
            break
        acc[at] += gain
        left -= most
    return acc


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item, those with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A to Z in
    lower case; null and empty texts have none. Weights and lengths are those of the module's
    integer BM25: with N documents that have a term, L terms in all, df documents with the
    term, tf of it in a document of n terms, w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 +
    50 n N div L, and a term adds w * (10^9 tf div (1000 tf + 20 m)). Equal scores are in
    ascending order of id, null ids last; repeated rows each have a rank. Texts of a repeated
    item id are one query. No column but the ids and texts is read. Terms are known by 64-bit
    hashes.
    """
    spark, found = docs.sparkSession, None
    for queries in read_queries(items, item_col, item_text_col):
        own = _rank(docs, queries, id_col, text_col, k)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _rank(docs: DataFrame, queries: list[tuple[int | None, np.ndarray]], id_col: str, text_col: str, k: int) -> DataFrame:
    wanted = np.unique(np.concatenate([np.empty(0, np.uint64), *(h for _, h in queries)]))
    index = written(index_blocks(docs, wanted, id_col, text_col), "index")
    n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = np.zeros(len(wanted), np.int64)
    counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    for term, n in counts.collect():  # a row for each term of the queries at most
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    rarest = [(item, (own := np.searchsorted(wanted, h))[np.lexsort((own, df[own]))]) for item, h in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in rarest]
        for batch in batches:
            for r in range(len(batch)):
                docs_, lengths, terms, dfs, at, tf = (batch.column(c)[r] for c in range(6))
                null = np.asarray(docs_.values.is_null())
                ids = np.asarray(docs_.values.fill_null(0))
                at, tf = np.frombuffer(at.as_py(), "<i4"), np.frombuffer(tf.as_py(), "<i4").astype(np.int64)
                m = 50 + 50 * np.frombuffer(lengths.as_py(), "<i8") * n_docs // max(1, n_terms)
                terms, dfs = np.asarray(terms.values), np.asarray(dfs.values).astype(np.int64)
                if not len(terms):
                    continue
                gain = np.repeat(weight[terms], dfs) * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
                first = np.append(0, np.cumsum(dfs))
                most = np.maximum.reduceat(gain, first[:-1])
                where = np.full(len(weight) + 1, -1, np.int64)
                where[terms] = np.arange(len(terms))
                for (_, own), top in zip(rarest, best):
                    there = where[own]
                    there = there[there >= 0]
                    if not len(there):
                        continue
                    acc = accumulate([(at[first[t] : first[t + 1]], gain[first[t] : first[t + 1]], int(most[t])) for t in there.tolist()], len(ids), k, top.least)
                    good = np.flatnonzero(acc >= max(1, top.least, kth_largest(acc, k)))
                    if len(good):
                        top.add(acc[good], ids[good], null[good])
        for (item, _), top in zip(rarest, best):
            n = len(top.score)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(top.doc, mask=top.null), pa.array(top.score)], names=["item_id", "doc_id", "score"])

    found = mapped(index.select("docs", "lengths", "terms", "dfs", "at", "tf"), run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(index)
    return out
