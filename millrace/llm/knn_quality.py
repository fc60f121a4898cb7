"""Quality scores by a vote of nearest labelled neighbours in a latent-semantic space.

Inverse document frequencies of hashed byte trigrams are counted over all documents. A
bounded sample of labelled documents is weighted by them, a truncated singular value
decomposition of it gives the latent space, and its vectors go to every task. Each document
is projected, its cosines with all labelled vectors are computed exactly, block by block,
and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import pieces, with_columns
from millrace.llm.langid import lowered, trigram_counts

BUCKETS = 1 << 12
LENGTHS = 16  # features for the order of magnitude of a text's length
ROWS = 512
#: Labelled documents that are kept: the model's size is at most this, whatever the corpus.
SAMPLE = 3000
DIMENSIONS = 64


def features(texts: list[bytes | None], buckets: int = BUCKETS) -> np.ndarray:
    """[text, bucket] log counts, and one for the order of magnitude of the length."""
    counts = trigram_counts([lowered(t) for t in texts], buckets).astype(np.float32)
    out = np.zeros((len(texts), buckets + LENGTHS), np.float32)
    out[:, :buckets] = np.log1p(counts)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.maximum(norm, 1e-9)
    size = np.minimum([len(t or b"").bit_length() for t in texts], LENGTHS - 1)
    out[np.arange(len(texts)), buckets + size] = 0.35
    return out


@dataclass
class Model:
    idf: np.ndarray  # [feature]
    axes: np.ndarray  # [feature, dimension]
    vectors: np.ndarray  # [labelled, dimension], of length 1
    labels: np.ndarray  # [labelled]
    prior: float


def document_frequencies(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """idf of each bucket over all texts of df; a row for each bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for _, texts in pieces(batch, 0):
                for low in range(0, len(texts), ROWS):
                    seen += (trigram_counts([lowered(t) for t in texts[low : low + ROWS]], buckets) > 0).sum(0)
                rows += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, buckets), pa.int32()), pa.array(np.append(rows, seen), pa.int64())], names=["bucket", "n"])

    rows = df.select(F.col(text_col)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(buckets + 1)
    n[rows["bucket"] + 1] = rows["n"]
    return np.append(np.log((1 + n[0]) / (1 + n[1:])) + 0.5, np.ones(LENGTHS)).astype(np.float32)


def truncated_svd(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """The k leading right singular vectors of x as columns, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(0).standard_normal((x.shape[1], k + 10)).astype(np.float32)
    for _ in range(rounds):
        left, _ = np.linalg.qr(x @ basis)
        basis, _ = np.linalg.qr(x.T @ left)
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    return basis @ right[:k].T


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE, dimensions: int = DIMENSIONS, buckets: int = BUCKETS) -> Model:
    """Fits the space on at most `sample` labelled documents, those of the least hashed ids.

    labels: rows of id and label 0 or 1; null labels and ids teach nothing, nor do ids that
    df lacks; repeated labels of an id count once (the largest). Document frequencies cover
    all of df. Without any labelled document every score is 0.5.
    """
    idf = document_frequencies(df, text_col, buckets)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample))
    texts = df.join(chosen, df[id_col] == chosen["__id"]).groupBy("__id").agg(F.max(F.struct(F.col("__y").alias("y"), df[text_col].alias("text"))).alias("row"))
    texts = texts.select(F.col("__id"), F.col("row.y").alias("y"), F.col("row.text").alias("text")).coalesce(1).sortWithinPartitions("__id")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            for part, values in pieces(batch, 2):
                ys += part.column(1).to_pylist()
                xs += [features(values[low : low + ROWS], buckets) * idf for low in range(0, len(values), ROWS)]
        x = np.concatenate(xs) if xs else np.zeros((0, len(idf)), np.float32)
        if not len(x):
            return
        axes = truncated_svd(x, min(dimensions, len(x), x.shape[1]))
        for name, v in (("axes", axes), ("vectors", x @ axes), ("labels", np.array(ys))):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["name", "value"])

    got = {r["name"]: np.frombuffer(r["value"], np.float32) for r in texts.mapInArrow(fit, "name string, value binary").collect()}
    if not got:
        return Model(idf, np.zeros((len(idf), 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    vectors = got["vectors"].reshape(len(got["labels"]), -1)
    return Model(idf, got["axes"].reshape(len(idf), -1), vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), got["labels"], float(got["labels"].mean()))


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, neighbours: int = 15, shrink: float = 0.05) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 where score >= 0.5).

    The nearest `neighbours` labelled vectors vote with weight cosine**8; `shrink` votes go
    to the labels' mean, which texts far from all get. Null and empty texts have only their
    length as a feature and are scored by it. Repeated rows get the same score each. Of
    neighbours that tie for the last place any vote, the same ones in every run. Columns of df named like a result
    give way to it.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most SAMPLE vectors
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        m = sent.value
        axes, k, buckets = m.axes * m.idf[:, None], min(neighbours, len(m.labels)), len(m.idf) - LENGTHS

        def block(texts):
            if not k:
                return np.full(len(texts), m.prior)
            v = features(texts, buckets) @ axes
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            cosine = v @ m.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 8
            return np.clip(((weight * m.labels[near]).sum(1) + shrink * m.prior) / (weight.sum(1) + shrink), 0, 1)

        def call(texts):
            s = np.concatenate([block(texts[low : low + ROWS]) for low in range(0, len(texts), ROWS)])
            return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

        return call

    return with_columns(df, text_col, fields, make, keep)
