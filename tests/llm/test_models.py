"""The two classifiers against plain versions from raw counts; very long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, knn_quality, langid

RANKS = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()


def grams(text):
    """Counts of hashed trigrams of bytes."""
    p = b" " + (text or "").lower().encode() + b" "
    return collections.Counter((((p[i] << 16 | p[i + 1] << 8 | p[i + 2]) * 0x9E3779B1) & 0xFFFFFFFF) >> 20 for i in range(len(p) - 2))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, score string, lang_pred string")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def test_language_from_raw_counts(spark, texts):
    taught, asked = [t for t in texts if t[0] % 4 != 2], [t for t in texts if t[0] % 4 == 2]
    model = langid.train(spark.createDataFrame([(t, g) for _, t, g in taught], "text string, lang string"))
    langs = sorted({g for _, t, g in taught if g is not None and t is not None})
    freq = np.zeros((len(langs), 4096))
    for _, t, g in taught:
        if g is not None and t is not None:
            for b, n in grams(t).items():
                freq[langs.index(g), b] += n
    share = (freq + 0.5) / (freq + 0.5).sum(1, keepdims=True)
    code = langid.codewords(len(langs))
    weights = np.stack([np.log(share[code[:, b] > 0].mean(0) / share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    weak = np.maximum(((share @ weights) * code).min(0), 0.01)
    weak /= weak.mean()
    assert model.langs == langs
    np.testing.assert_allclose(model.weights, weights, atol=1e-9)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame(spark, [t[:2] for t in asked]), model).collect()}
    for i, t, _ in asked:
        counts = grams(t)
        n = sum(counts.values())
        if not t or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        margin = sum(k * weights[b] for b, k in counts.items()) / n * min(n, 400) ** 0.5
        loss = np.array([(np.log1p(np.exp(-margin * row)) * weak).sum() for row in code])
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        assert got[i][1] == pytest.approx(p.max(), abs=1e-3)
        assert got[i][0] == langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3


def test_quality_from_raw_counts(spark, sf, texts):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    known = {r["doc_id"]: r["quality"] for r in labels.orderBy("doc_id").limit(60).collect()}  # fewer than dimensions: the space is theirs
    table = frame(spark, [t[:2] for t in texts])
    model = knn_quality.train(table, spark.createDataFrame(list(known.items()), "doc_id long, quality int"))
    by_id = {i: t for i, t, _ in texts}
    known = {i: y for i, y in known.items() if i in by_id}
    counts = {i: grams(t) for i, t in by_id.items()}
    seen = collections.Counter(b for c in counts.values() for b in c)
    idf = np.log((1 + len(by_id)) / (1 + np.array([seen[b] for b in range(4096)]))) + 0.5

    def vector(i):
        v = np.zeros(4096 + 16)
        for b, n in counts[i].items():
            v[b] = np.log1p(n)
        v /= max(np.linalg.norm(v), 1e-9)
        v[:4096] *= idf
        v[4096 + min(len((by_id[i] or "").encode()).bit_length(), 15)] = 0.35
        return v

    x = np.stack([vector(i) for i in sorted(known)])
    axes = np.linalg.svd(x, full_matrices=False)[2].T
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)
    near, y = unit(x @ axes), np.array([known[i] for i in sorted(known)])
    got = {r["doc_id"]: r["score"] for r in knn_quality.score(table, model, keep=["doc_id"]).collect()}
    apart = []
    for i in by_id:
        cosine = near @ unit(vector(i) @ axes)
        top = np.argsort(-cosine, kind="stable")[:15]
        w = np.maximum(cosine[top], 0) ** 8
        apart.append(abs(got[i] - (w @ y[top] + 0.05 * y.mean()) / (w.sum() + 0.05)))
    assert np.quantile(apart, 0.97) < 2e-3 and max(apart) < 0.1  # ties for the last place may vote otherwise


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["the", "of", "house", "green", "and", "é漢", "12"]) for _ in range(400_000))
    item = "a question that nobody else would ask in just these words about a green house near the river"
    rows = [(1, long + " " + item), (2, None), (3, ""), (4, "tiny")]
    encoded = {r["doc_id"]: r for r in bpe.encode(frame(spark, rows), RANKS, keep=["doc_id"], tokens=False).collect()}
    assert encoded[1]["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest() and encoded[1]["n_tokens"] > 400_000 and encoded[2]["n_tokens"] == encoded[3]["n_tokens"] == 0
    found = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc"], r["item"]) for r in found] == [(1, 7)]
    model = langid.train(spark.createDataFrame([(long, "en"), ("der die das und ein haus", "de")], "text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(frame(spark, rows[:3]), model).collect()} == {1: "en", 2: "und", 3: "und"}
    quality = knn_quality.train(frame(spark, rows), spark.createDataFrame([(1, 1), (4, 0), (2, 0)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in knn_quality.score(frame(spark, rows), quality).collect()}
    assert got[1] > 0.9 and got[4] < 0.5 and set(got) == {1, 2, 3, 4}


def test_ties_repeats_and_empty_tables(spark):
    same = [(1, "one text"), (1, "one text"), (2, "one text"), (None, "one text")]
    model = langid.train(spark.createDataFrame([("abc abd", "x"), ("abc abd", "y")], "text string, lang string"))  # two languages with the same words
    assert {tuple(r) for r in langid.predict(frame(spark, same), model, keep=["doc_id"]).select("lang_pred", "ambiguous").collect()} == {("x", True)}
    quality = knn_quality.train(frame(spark, same), spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int"))
    assert len({r["score"] for r in knn_quality.score(frame(spark, same), quality).collect()}) == 1
    assert {r["n_tokens"] for r in bpe.encode(frame(spark, same), RANKS, tokens=False).collect()} == {2}
    none = frame(spark, [])
    assert bpe.encode(none, RANKS).isEmpty() and langid.predict(none, model).isEmpty() and knn_quality.score(none, quality).isEmpty()
    assert decontaminate.contaminated(none, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).isEmpty()
    assert decontaminate.without_contaminated(none, none.select(F.col("doc_id").alias("item_id"), "text")).isEmpty()
