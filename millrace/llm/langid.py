"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a binary n-gram classifier tells the languages
with a one from those with a zero: its weights are log ratios of hashed byte trigram
frequencies, counted by Spark over all training texts. Decoding sums each codeword's
logistic losses, a bit weighing more the better it separates the languages, and takes the
codeword of least loss; a near second makes the answer ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import pieces, with_columns

BUCKETS = 1 << 12
#: Texts in one matrix of counts, so that memory is bounded for very short texts too.
ROWS = 1024
#: Bytes of a text whose trigrams are counted at once.
PART = 1 << 21
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter by its Unicode category; fractions, superscripts and Roman numerals are none."""
    return any(m[0].isalpha() for m in _LETTER_OR_NUMBER.finditer(text))


def trigram_counts(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """[text, bucket] counts of hashed byte trigrams of lower-cased texts, with a space before and after; long texts go in parts that share two bytes."""
    padded = [b" " + t + b" " for t in texts]
    if any(len(p) > PART for p in padded):
        parts = [(k, p[low : low + PART + 2]) for k, p in enumerate(padded) for low in range(0, max(1, len(p) - 2), PART)]
        out = np.zeros((len(texts), buckets), np.int64)
        for k, part in parts:
            out[k] += _counts([part], buckets)[0]
        return out
    return _counts(padded, buckets)


def _counts(padded: list[bytes], buckets: int) -> np.ndarray:
    sizes = np.array([len(p) for p in padded], np.int64)
    data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    gram = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(padded)), sizes)[:-2]
    whole = np.ones(len(gram), bool)  # not across two texts
    cross = np.concatenate([ends[:-1] - 2, ends[:-1] - 1]) if len(ends) > 1 else np.empty(0, np.int64)
    whole[cross[(cross >= 0) & (cross < len(gram))]] = False
    return np.bincount((owner * buckets + slot)[whole], minlength=len(padded) * buckets).reshape(len(padded), buckets)


def lowered(text: bytes | None) -> bytes:
    return b"" if text is None else text.decode("utf-8", "replace").lower().encode("utf-8", "replace")


def codewords(k: int, bits_per_log2: int = 10) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code up to 7 languages, then the widest-spread of some random codes."""
    if k <= 7:
        bits = max(1, 2 ** (k - 1) - 1)
        grid = (np.arange(1, bits + 1)[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.concatenate([np.zeros((1, bits), int), grid])[:k] * 2 - 1
    bits, best, spread = int(np.ceil(bits_per_log2 * np.log2(k))), None, -1
    for seed in range(40):
        code = np.random.default_rng(seed).integers(0, 2, (k, bits)) * 2 - 1
        code = code[:, np.abs(code.sum(0)) < k]
        near = (code.shape[1] - code @ code.T) // 2 + np.eye(k, dtype=int) * bits
        if near.min() > spread:
            best, spread = code, near.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # [language, bit]
    weights: np.ndarray  # [bucket, bit]
    bit_weights: np.ndarray  # [bit], mean 1


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> Model:
    """Counts trigrams of every text by language (a row for each language and bucket reaches the driver) and fits the bits.

    Rows without a language or a text teach nothing. No rows: a model without languages.
    """
    src = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in pieces(batch, 1):
                langs = np.array(part.column(0).to_pylist(), object)
                for low in range(0, len(texts), ROWS):
                    counts = trigram_counts([lowered(t) for t in texts[low : low + ROWS]], buckets)
                    own = langs[low : low + ROWS]
                    for lang in set(own):
                        sums[lang] = sums.get(lang, 0) + counts[own == lang].sum(0)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = src.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    if not langs:
        return Model([], np.empty((0, 0)), np.empty((buckets, 0)), np.empty(0))
    freq = np.zeros((len(langs), buckets))
    freq[rows["lang"].map({g: i for i, g in enumerate(langs)}), rows["bucket"]] = rows["n"]
    share = (freq + 0.5) / (freq + 0.5).sum(1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((buckets, code.shape[1]))
    for b in range(code.shape[1]):
        ones, zeros = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(ones) and len(zeros):
            weights[:, b] = np.log(ones.mean(0)) - np.log(zeros.mean(0))
    margin = (share @ weights) * code  # what a typical trigram of each language says for its own side
    weak = np.maximum(margin.min(0), 0.01)
    return Model(langs, code, weights, weak / weak.mean())


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, ambiguous_below: float = 0.2) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous (the best two scores lie nearer than ambiguous_below).

    Texts that are null or have no letter, and all texts where the model knows no language,
    are `und` with score 0 and ambiguous. Of languages with equal scores the first by name is given. Repeated rows get the same answer each. Columns of
    df named like a result give way to it. Texts are read whole, however long.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    langs, code, weights, bit_weights, buckets = model.langs, model.code, model.weights.astype(np.float32), model.bit_weights, model.weights.shape[0]

    def make():
        def block(texts):
            known = np.array([bool(t and langs and has_letter(t.decode("utf-8", "replace"))) for t in texts])
            names, score, close = np.array(["und"] * len(texts), object), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known.any():
                counts = trigram_counts([lowered(t) for t, k in zip(texts, known) if k], buckets).astype(np.float32)
                n = np.maximum(counts.sum(1, keepdims=True), 1)
                margin = (counts @ weights) / n * np.minimum(n, 400) ** 0.5
                loss = np.log1p(np.exp(-margin[:, None, :] * code[None])) @ bit_weights  # [text, language]
                p = np.exp(loss.min(1, keepdims=True) - loss)
                p /= p.sum(1, keepdims=True)
                best = np.argmax(p, 1)
                top = np.sort(p, 1)[:, ::-1]
                names[known], score[known] = np.array(langs, object)[best], top[:, 0]
                close[known] = top[:, 0] - (top[:, 1] if len(langs) > 1 else 0) < ambiguous_below
            return names, score, close

        def call(texts):
            out = [block(texts[low : low + ROWS]) for low in range(0, len(texts), ROWS)]
            cols = [np.concatenate(c) for c in zip(*out)]
            return [pa.array(cols[0].tolist(), pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())]

        return call

    return with_columns(df, text_col, fields, make, keep)
