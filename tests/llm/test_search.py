"""Ranked search, token alignment and the license scan, each against a plain version."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import align, licenses, ranked

SCHEMA = "doc_id long, text string, score string, rank string, labels string"
HARD = [None, "", " \n\t", "a", "é" * 3000, "The the THE", "cc by", "x" * 200_000, "<|endoftext|> </s> <unk>", "a▁b", "tab\tand  two spaces\n\n", "ﬁ №", "\x00 nul", "日本語 テキスト", "Gnu General\nPublic-License!"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


# 11: ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_rank(docs, items, k):
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(w for _, c in own for w in c)
    queries = collections.defaultdict(set)
    for i, t in items:
        queries[i] |= set(terms(t))
    out = set()
    for item, wanted in queries.items():
        found = []
        for i, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in wanted if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out |= {(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)}
    return out


@pytest.mark.parametrize("k,block", [(3, 8192), (5, 4), (50, 16)])
def test_rank(spark, monkeypatch, k, block):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    rng = random.Random(k)
    words = [f"W{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    docs = list(enumerate(HARD)) + [(100 + i // 2, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    docs += [(900 + i, "w1 w2 w3 w3") for i in range(30)] + [(None, "w1 w2 w3 w3"), (None, "w7")]  # ties and null ids
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(12)] + [(3, "w7 w8"), (50, None), (51, "never seen"), (52, "the cc by")]
    got = ranked.rank(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_rank(docs, items, k)


def test_rank_in_passes_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(ranked, "QUERIES_A_PASS", 2)
    docs, items = [(i, f"a{i % 3} b{i % 5} c") for i in range(40)], [(i, f"a{i} c b{i}") for i in range(5)]
    read = spark.createDataFrame(items, "item_id long, text string")
    parts = list(ranked.read_queries(read, most=2))
    assert len(parts) == 3 and sorted(i for p in parts for i, _ in p) == list(range(5))
    assert {tuple(r) for r in ranked.rank(frame(spark, docs), read, k=4).collect()} == brute_rank(docs, items, 4)
    assert ranked.rank(frame(spark, []), read).isEmpty() and ranked.rank(frame(spark, docs), read.limit(0)).isEmpty()


def test_accumulators_are_limited():
    """A frequent term that can add little makes none, and still reaches those that are there."""
    many = np.arange(1000)
    rare = (np.arange(10), np.full(10, 500), 500)
    acc = ranked.accumulate([rare, (many, np.full(1000, 3), 3)], 1000, 10, 1)
    assert (acc > 0).sum() == 10 and set(acc[:10].tolist()) == {503}
    assert (ranked.accumulate([rare, (many, np.full(1000, 500), 500)], 1000, 10, 1) > 0).all()  # a tie may enter
    assert not ranked.accumulate([rare, (many, np.full(1000, 3), 3)], 1000, 10, 504).any()


# 12: alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_align(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    rows = []
    for i, t in docs:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not t or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + t).encode()}:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links = [(x, y) for x, (p, q) in zip(ids_a, spans[0]) for y, (r, s) in zip(ids_b, spans[1]) if max(p, r) < min(q, s)]
        common = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        groups = [(",".join(str(x) for x, (_, q) in zip(ids_a, spans[0]) if low < q <= high), ",".join(str(x) for x, (_, q) in zip(ids_b, spans[1]) if low < q <= high)) for low, high in zip([0, *common], common)]
        text = ";".join("|".join(g) for g in groups)
        rows.append((i, ids_a, ids_b, len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    counts = collections.Counter(x for r in rows for x in r[4])
    top = collections.defaultdict(int)
    for (x, y), n in counts.items():
        top[y] = max(top[y], n)
    return collections.Counter((i, len(p), len(q), g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for i, p, q, g, links, sha in rows)


@pytest.mark.parametrize("most", [align.SLICE, 150])
def test_align(spark, sf, most):
    rng = random.Random(4)
    docs = [(i, t if t is None or len(t) < 10_000 else t[:3000]) for i, t in enumerate(HARD)] + [(None, "no id"), (5, "again")] + [(200, "same text, two rows")] * 2
    docs += [(1000 + r["doc_id"], r["text"][:1500]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").limit(40).collect()]
    rng.shuffle(docs)
    got = align.align(frame(spark, docs), A, B, slice_pairs=most)
    assert collections.Counter(map(tuple, got.collect())) == brute_align(docs)


def test_align_a_long_text_and_nothing(spark):
    rng = random.Random(5)
    text = "".join(rng.choice([" word", "ing", "é", "<", "\n", " 12", "漢"]) for _ in range(150_000))
    r = align.align(frame(spark, [(1, text)]), A, B).first()
    assert r["n_a"] > 50_000 and r["n_links"] >= max(r["n_a"], r["n_b"]) and r["n_groups"] <= min(r["n_a"], r["n_b"]) and r["count_sum"] >= r["n_links"]
    assert align.align(frame(spark, []), A, B).isEmpty()


@pytest.mark.parametrize("step", [1, 2, 5, 32])
def test_pieces_of_the_merge(step):
    rng = random.Random(step)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(0, 5)):
            n = rng.randrange(0, 40)
            docs.append(tuple(sorted({n, *rng.sample(range(1, n + 1), rng.randrange(0, n))}) if n else [] for _ in "ab"))
        a, b = (np.array([x for d in docs for x in d[k]], np.int64) for k in range(2))
        a_cut, b_cut = (np.append(0, np.cumsum([len(d[k]) for d in docs])).astype(int) for k in range(2))
        x, y, group_a, group_b = align.overlaps(a, b, a_cut, b_cut, step)
        want, groups = [], 0
        for k, (p, q) in enumerate(docs):
            want += [(i + int(a_cut[k]), j + int(b_cut[k])) for i in range(len(p)) for j in range(len(q)) if max([0, *p][i], [0, *q][j]) < min(p[i], q[j])]
            common = sorted(set(p) & set(q))
            assert group_a[a_cut[k] : a_cut[k + 1]].tolist() == [groups + int(np.searchsorted(common, e)) for e in p]
            assert group_b[b_cut[k] : b_cut[k + 1]].tolist() == [groups + int(np.searchsorted(common, e)) for e in q]
            groups += len(common)
        assert list(zip(x.tolist(), y.tolist())) == want
        work = align.split_paths(a, b, a_cut, b_cut, step)[3]
        assert int(work.sum()) == len(a) + len(b) and (not len(work) or 0 < work.min() <= work.max() <= step)


# 13: licenses


def test_scan_like_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    pd = pytest.importorskip("pandas")
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice(["the", "of", "this", "house", "version", "terms", "by"]) for _ in range(n))
    texts = [*HARD, filler(400), "mit license mit license the mit license", "gnu general public", "CC-BY and cc BY-nc 4.0"]
    for t in licenses.TEMPLATES:
        w = t.text.split()
        texts += [f"{filler(30)} {t.text} {filler(30)}", t.text.upper(), " ".join(w[: len(w) // 2]), " ".join(x for x in w if rng.random() > 0.15), " ".join(y for x in w for y in ([x, "extra"] if rng.random() < 0.1 else [x])), " ".join(rng.sample(w, len(w)))]
    rows = list(enumerate(texts)) + [(None, "Released under the MIT License."), (3, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY-NC 4.0.")]
    got = licenses.scan(frame(spark, rows)).drop("found")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": pd.array([t for _, t in rows], "string")}))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({licenses.oracle()})").fetchall()
    clean = lambda found: collections.Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found)
    assert clean(map(tuple, got.collect())) == clean(want)


def test_scan_labels(spark):
    gpl = licenses.TEMPLATES[1].text
    moved = gpl.replace("free software", "free and open software by Ann Bo").replace("redistribute", "copy, share")
    rows = [(1, gpl), (2, moved), (3, "Permission is hereby granted, free of charge, " + licenses.TEMPLATES[8].text[46:]), (4, licenses.TEMPLATES[8].text.replace("without restriction", "with limits")), (5, "a text about a license"), (6, None), (7, "x " * 30_000 + "Released under the MIT License.")]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1]["labels"] == "gpl,gpl-3.0" and got[1]["score"] == 1.0 and got[2]["labels"] == "gpl,gpl-3.0" and 0.5 <= got[2]["score"] < 1
    assert (got[3]["base_labels"], got[3]["labels"], got[4]["labels"], got[5]["labels"]) == ("", "mit", "", "")  # a key phrase is missing in 4
    assert (got[6]["n_words"], got[6]["first_word"], got[6]["labels"], got[6]["score"]) == (0, None, "", 0.0)
    assert (got[7]["first_word"], got[7]["last_word"], got[7]["labels"], got[7]["found"][0]["label"]) == (30_003, 30_003, "mit", "mit")
    assert licenses.scan(frame(spark, [])).isEmpty()


def test_scan_stays_in_the_jvm(spark):
    plan = licenses.scan(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
