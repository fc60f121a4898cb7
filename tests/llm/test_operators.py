"""The operators of millrace.llm against brute force and the libraries, with nulls, empty, long and repeated rows."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, decontaminate, jaccard_join, knn_quality, langid, links, paragraphs, repetition, shingles, token_store, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
WORDS = "the of and on er to re sh in it ha ou thing was an be for with ed ly".split()
HARD = ["", None, "a", " ", "\n\n", "don't 's'sl 'tis  x y\t　z", "é漢字 ½ 12ab\x1c\x85 q", "<|endoftext|> \\<turn>", "word " * 3000, "x" * 5000]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs(spark, rows, extra=True):
    """doc_id, text and columns whose names clash with results."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    return df.withColumns({"kept": F.lit("own"), "score": F.lit(9), "id": F.lit(1), "doc": F.lit("x"), "n": F.lit(2), "component_id": F.lit(0)}) if extra else df


# 2: quality rules


def brute_repeats(ids, least):
    n, hit, longest = len(ids), set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and ids[i + k] == ids[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                hit |= set(range(i, i + k)) | set(range(j, j + k))
    return hit, longest


@pytest.mark.parametrize("alphabet", [1, 2, 4, 30])
def test_maximal_repeats(alphabet):
    rng = random.Random(alphabet)
    for _ in range(40):
        ids = np.array([rng.randrange(alphabet) for _ in range(rng.randrange(0, 40))], np.int64)
        starts, ends, longest = repetition.maximal_repeats(ids, 3)
        hit, want = brute_repeats(ids.tolist(), 3)
        assert set().union(*[range(a, b) for a, b in zip(starts, ends)]) == hit and longest == want
        for least in (1, 2):
            text = " ".join(f"w{i}" for i in ids.tolist())
            *_, longest, spans = repetition.measure(text.encode(), least)
            hit, want = brute_repeats(ids.tolist(), least)
            assert set().union(*[range(s["start"], s["end"]) for s in spans]) == hit and longest == (want if want >= least else 0)
        order, lcp = repetition.suffix_array(ids)
        assert [ids[i:].tolist() for i in order] == sorted(ids[i:].tolist() for i in range(len(ids)))


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [*HARD, "a b c a b c\nx\nx\n \n", "# * <|>&$% x", prose(rng, 80), "\n".join([prose(rng, 30)] * 4), "one two " * 60]
    found = {r["doc_id"]: r for r in repetition.quality_rules(docs(spark, enumerate(texts)), keep=["doc_id"]).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        w, r = words_of(t), found[i]
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
    assert found[len(texts) - 3]["kept"] and not found[len(texts) - 2]["kept"] and not found[0]["kept"]
    kept = repetition.quality_rules(docs(spark, enumerate(texts)), only_kept=True)
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}
    assert repetition.quality_rules(docs(spark, [])).isEmpty()


# 4: byte-level BPE


def test_split_and_merge_like_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    regex = pytest.importorskip("regex")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(2)
    alphabet = [*"ab st re've'll md  \n\t 　\x1c\x8512½é漢!?.", "'s", "'re", " '"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 300))) for _ in range(300)] + [t or "" for t in HARD]
    for t, (a, b) in zip(texts, bpe.split(texts)):
        assert [t[x:y] for x, y in zip(a, b)] == pattern.findall(t)
    ids = bpe._encode(RANKS, True)()([t.encode() for t in texts])[0].to_pylist()
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert bpe.merge_all([b"", b"thing", b"q"], RANKS)[0].tolist() == []


def test_encode_decode(spark):
    df = docs(spark, list(enumerate(HARD)) + [(3, " ")])
    out = bpe.encode(df, RANKS).withColumn("ids_sha256", F.lit("clash"))
    again = bpe.decode(bpe.encode(out, RANKS), RANKS)
    rows = again.collect()
    assert len(rows) == len(HARD) + 1 and all(r["decoded"] == (r["text"] or "") for r in rows)
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["decoded_sha256"] == hashlib.sha256(data).hexdigest() and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"]) == len(r["offsets"]) - 1 and r["offsets"][-1] == len(data)
        assert data[2:9] in bpe.decode_ids(r["ids"], RANKS, r["offsets"], 2, 9)


# 3: token store


def test_token_store(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE_JSON)
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100 + i, prose(rng, rng.randrange(1, 200))) for i in range(60)] + [(-5, "minus"), (7, "again"), (None, "no id"), (300, "a <|endoftext|> b"), (301, "x<|endoftext|><|endoftext|>\n y"), (302, "<|endoftext")]
    rng.shuffle(rows)
    path = token_store.write(docs(spark, rows), BPE_JSON)
    got = token_store.read(spark, path).orderBy("start").collect()
    want = sorted(((i is not None, i if i is not None else 0, t is not None, t or ""), i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    assert [r["doc_id"] for r in got] == [i for _, i, _ in want]
    start = 0
    for r, (_, i, ids) in zip(got, want):
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_store.read_document(spark, path, 105).tolist() == next(ids for _, i, ids in want if i == 105)
    assert token_store.read_document(spark, path, 4242) is None
    assert token_store.load_dictionary(spark, path)[1]
    empty = token_store.write(docs(spark, []), BPE_JSON)
    assert token_store.read(spark, empty).isEmpty()


def test_encoder_empties_its_table():
    encoder, rng = token_store.Encoder(BPE_JSON, bits=8), random.Random(4)
    texts = [prose(rng, 50) for _ in range(20)]
    for t in texts:
        assert encoder([t.encode()])[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_with_more_stretches_than_places():
    encoder, rng = token_store.Encoder(BPE_JSON, bits=6), random.Random(5)
    for n in (200, 3, 3000, 10):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
        assert encoder([text.encode(), b"", b"a b"])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.bits == 6 or encoder.used <= 0.6 * (1 << encoder.bits)


def test_encoder_of_another_tokenizer(tmp_path):
    made = json.load(open(BPE_JSON, encoding="utf-8"))
    made["pre_tokenizer"]["use_regex"] = False
    path = tmp_path / "whole.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    encoder = token_store.Encoder(str(path))
    text = "the cat  sat on the mat " * 20
    assert not encoder.by_stretch and encoder([text.encode()])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_text(spark):
    rng = random.Random(91)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(650_000))
    assert len(text) > 5_000_000
    encoder = token_store.Encoder(BPE_JSON)
    own = encoder([text.encode()])[0]
    assert own.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    df = docs(spark, [(1, text), (2, text), (3, text[:3_000_000])])
    assert {r["doc"]: r["component_id"] for r in jaccard_join.similar_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {(r["doc"], r["removed"]) for r in paragraphs.repeats(df).collect()} >= {(1, False), (2, True), (3, True)}
    assert {r["n_words"] for r in repetition.quality_rules(df).collect()} == {650_000, len(words_of(text[:3_000_000]))}


# 1: WARC


def test_warc(spark, tmp_path):
    big, trap = "<p>" + "é" * 600, "x" * 1200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", trap), (9, "u", trap), (None, "u", big), (10, "u", "b" * 1500), (10, "u", "b" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("record_type", F.lit("z"))
    got = warc.deduplicated(pages, f"file://{tmp_path}/warc").collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(j for j, _, x in rows if j is not None and (x or "") == (h or ""))
        revisit = len(data) >= 1000 and top != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert warc.deduplicated(pages.where("page_id > 99")).isEmpty()


# 5 and 6: similarity


def sets_of(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words_of(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(sets, percent):
    names = list(sets)
    up = {x: x for x in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {x: find(x) for x in names}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


def near_copies(rng):
    texts = [*HARD, "A b", "a  B", "one two three", "ONE two\nthree"]
    for size in (6, 12, 25, 60, 200):
        base = prose(rng, size)
        texts += [base, base.upper()] + [edited(rng, base, rng.randrange(0, 1 + size // 25)) for _ in range(12)] + [edited(rng, base, 1 + size // 15) for _ in range(6)]
    return texts


@pytest.mark.parametrize("k,percent,plan", [(3, 90, jaccard_join.allocate), (5, 80, jaccard_join.allocate), (3, 80, lambda n, s, m: (0, m // 2 + 1))])
def test_similar_components(spark, k, percent, plan):
    texts = near_copies(random.Random(k))
    df = docs(spark, [*enumerate(texts), (2, "a"), (None, "a")])
    got = jaccard_join.similar_components(df, k=k, percent=percent, plan=plan).collect()
    assert len(got) == len(texts) + 2
    sets = {i: sets_of(t, k) for i, t in enumerate(texts)}
    want = brute_components(sets, percent)
    for r in got:
        if r["doc"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc"]]), want[r["doc"]]), r
    assert len(set(want.values())) < len(texts) - 40


def test_keep_one_and_empty(spark):
    df = docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, ""), (4, None), (5, "z")])
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5]
    assert jaccard_join.similar_components(docs(spark, [])).isEmpty()


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_probe(percent):
    rng = np.random.default_rng(percent)
    for plan in (jaccard_join.allocate, lambda n, s, m: (0, m // 2 + 1), lambda n, s, m: (max(0, m + 1 - 2 * (m // 4)), m // 4)):
        schemes = jaccard_join.bands(2000, percent, None, plan)
        for n in [1, 2, 3, 5, 7, 9, 10, 12, 19, 40, 120, 500] * 6:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = rng.integers(0, max(1, n // 8) + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 8) + 1)).astype(np.uint64)]))
            c = shingles.common(a, b)
            if not len(b) or 100 * c < percent * (len(a) + len(b) - c):
                continue
            probes = []
            for x in (a, b):
                at, partner, own = int(jaccard_join.band_of(len(x), schemes)), jaccard_join.largest_partner(len(x), percent), {}
                for number in (at, at + 1):
                    if number == at or partner > schemes[at].high:
                        need = jaccard_join.differ(len(x), min(partner, schemes[number].high), percent) + 1
                        for s, p in zip(*jaccard_join.signatures(x, 0, schemes[number], number, need, number == at)):
                            own[s] = own.get(s, False) or p
                probes.append(own)
            assert any(s in probes[1] and (p or probes[1][s]) for s, p in probes[0].items())


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(links.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k: v for k, v in got.items() if k < 100} == {i: 0 for i in range(41)} and {got[i] for i in (100, 150, 200)} == {100}


def test_sketches_bound_differences():
    a, b = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 90).astype(np.uint64)), np.unique(np.random.default_rng(1).integers(0, 1 << 63, 30).astype(np.uint64))
    both = np.union1d(a, b)
    s = links.sketches(np.concatenate([a, both]), np.array([0, len(a), len(a) + len(both)]))
    assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in s[0] ^ s[1]) <= len(both) - len(a)


def brute_lines(texts):
    """Component of each line with words, as (doc, line)."""
    return brute_components({(i, j): sets_of(x, 5) for i, t in texts.items() for j, x in enumerate((t or "").split("\n")) if words_of(x)}, 80)


def brute_cuts(texts, first, least=paragraphs.LEAST_CUT):
    """Lines that go: removed ones that have so many words together with removed ones next to them."""
    gone = set()
    for i, t in texts.items():
        run = []
        for j, x in [*((j, x) for j, x in enumerate((t or "").split("\n")) if words_of(x)), (-1, "")]:
            if j >= 0 and first[(i, j)] != (i, j):
                run.append((j, len(words_of(x))))
            else:
                gone |= {(i, k) for k, _ in run} if sum(n for _, n in run) >= least else set()
                run = []
    return gone


def brute_spans(texts, gone, least=paragraphs.LEAST_CUT):
    """(doc, first word, end, removed) of passages that two places share, joined where they overlap."""
    size, beside = paragraphs.STRETCH, paragraphs.PASSAGE - paragraphs.STRETCH
    places, blocks = collections.defaultdict(set), {}
    for d, t in texts.items():
        at, block = 0, []
        for j, x in enumerate((t or "").split("\n")):
            n = len(words_of(x))
            if (d, j) in gone:
                block = []
            elif n:
                if not block:
                    blocks.setdefault(d, []).append((at, block))
                block += [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(x)]
            at += n
        for start, w in blocks.get(d, []):
            key = shingles.runs(shingles.words([" ".join(w).encode()]).hashes, 3).tolist()
            for p in range(len(w) - paragraphs.PASSAGE + 1):
                k = min(range(p, p + beside + 1), key=lambda i: (key[i], i))
                places[tuple(w[k : k + size])].add((d, start + k))

    def context(d, at):
        start, w = next(b for b in blocks[d] if b[0] <= at < b[0] + len(b[1]))
        k = at - start
        return w[max(0, k - beside) : k][::-1], w[k + size : k + size + beside]

    found = set()
    for v in places.values():
        c = min(v)
        for d, at in v - {c}:
            n = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(context(d, at), context(*c))]
            if n[0] + size + n[1] >= least:
                found |= {(d, at - n[0], at + size + n[1], True), (c[0], c[1] - n[0], c[1] + size + n[1], False)}
    out = []
    for d, a, b, removed in sorted(found, key=lambda x: (x[0], x[3], x[1])):
        if out and out[-1][0] == d and a <= out[-1][2] and out[-1][3] == removed:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([d, a, b, removed])
    return {tuple(x) for x in out}


def brute_cut(doc, text, gone_lines, spans):
    """The text without lines that go and removed spans, word by word."""
    gone = {k for d, a, b, removed in spans if d == doc and removed for k in range(a, b)}
    out, k = [], 0
    for j, line in enumerate(text.split("\n")):
        parts = re.split(r"([^\x20\x09-\x0D]+)", line)
        mine = [k + i for i in range(len(parts) // 2)]
        k += len(mine)
        if (doc, j) in gone_lines:
            continue
        kept = ""
        for i, word in enumerate(mine):
            inside = word in gone and i and word - 1 in gone  # white space between two words that go goes too
            kept += ("" if inside else parts[2 * i]) + ("" if word in gone else parts[2 * i + 1])
        kept += parts[-1]
        if not mine or words_of(kept):
            out.append(kept)
    return "\n".join(out)


def test_paragraphs(spark):
    rng = random.Random(9)
    lines = [prose(rng, n) for n in (60, 60, 45, 41, 30, 12, 4, 1)]
    rows = [(i, "\n".join(rng.sample(lines, 5) + [prose(rng, 50), "short line", ""])) for i in range(12)] + [(50 + i, edited(rng, lines[0], 1)) for i in range(6)] + [(90, None), (91, ""), (92, "short line")]
    texts, df = dict(rows), docs(spark, [*rows, rows[0], (None, lines[1])]).withColumn("n_chars", F.length("text"))
    want = brute_lines(texts)
    many = collections.Counter(want.values())
    gone = brute_cuts(texts, want)
    spans = brute_spans(texts, gone)
    found = paragraphs.repeats(df).collect()
    assert {(r["doc"], r["at"]): (r["class_doc"], r["class_at"]) for r in found if r["kind"] == "line"} == {k: v for k, v in want.items() if many[v] > 1}
    assert {(r["doc"], r["at"]) for r in found if r["kind"] == "line" and r["cut"]} == gone and gone
    assert {(r["doc"], r["at"], r["at"] + r["n_words"], r["removed"]) for r in found if r["kind"] == "stretch"} == spans
    out = paragraphs.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.where("doc_id IS NOT NULL").collect()}
    assert left == {i: (t and brute_cut(i, t, gone, spans), t if t is None else len(brute_cut(i, t, gone, spans))) for i, t in rows}
    assert paragraphs.without_repeats(docs(spark, [])).isEmpty()


def test_passages_are_found_whole(spark):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (50, 51, 68, 100, 300)]
    rows = [(100 * p + i, prose(rng, rng.randrange(5, 90)) + rng.choice([" ", ". ", "\n"]) + x + " " + prose(rng, rng.randrange(0, 60))) for p, x in enumerate(passages) for i in range(8)] + [(900 + i, prose(rng, 150)) for i in range(12)]
    found = paragraphs.repeats(docs(spark, rows)).collect()
    assert {r["doc"] for r in found} == {100 * p + i for p in range(5) for i in range(8)} and {r["doc"] for r in found if r["cut"]} == {100 * p + i for p in range(5) for i in range(1, 8)}
    texts = dict(rows)
    inside = collections.defaultdict(set)
    for r in found:
        inside[r["doc"]] |= set(range(r["at"], r["at"] + r["n_words"]))
    for p, x in enumerate(passages):
        for i in range(8):
            w, own = words_of(texts[100 * p + i]), words_of(x)
            at = next(k for k in range(len(w)) if w[k : k + len(own)] == own)
            assert set(range(at, at + len(own))) <= inside[100 * p + i]


def test_what_is_cut_stays_once(spark):
    rng = random.Random(31)
    passage, base = prose(rng, 51), prose(rng, 600).split()
    near = " ".join([*base[:300], *words_of(passage), *base[351:]])
    rows = [(1, " ".join(base)), (2, near), (3, prose(rng, 30) + " " + passage + " " + prose(rng, 30)), (4, passage + " " + prose(rng, 60))]
    left = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs(spark, rows)).collect()}
    assert left[2] == "" and left[1] == rows[0][1]
    assert [passage in left[i] for i in (3, 4)] == [True, False]
    overlap = prose(rng, 160).split()  # stretches whose first places overlap
    rows = [(i, prose(rng, 20) + " " + " ".join(overlap[a:b]) + " " + prose(rng, 20)) for i, (a, b) in enumerate([(60, 160), (0, 100), (20, 130), (0, 160), (40, 120)])]
    left = " ".join(r["text"] for r in paragraphs.without_repeats(docs(spark, rows)).collect()).split()
    have = collections.Counter(left)
    assert all(have[w] >= 1 for t in dict(rows).values() for w in words_of(t))
    assert all(sum(left[k : k + 5] == overlap[a : a + 5] for k in range(len(left))) >= 1 for a in range(0, 50))


def test_short_paragraphs(spark):
    rng = random.Random(21)
    short = [prose(rng, n) for n in (1, 2, 5, 7, 8, 20, 31)]
    rows = [(i, "\n".join(y for x in short for y in (prose(rng, 12), x))) for i in range(3)] + [(9, short[-1] + " " + prose(rng, 1))]
    want = brute_lines(dict(rows))
    many = collections.Counter(want.values())
    found = [r for r in paragraphs.repeats(docs(spark, rows)).collect() if r["kind"] == "line"]
    got = {(r["doc"], r["at"]): (r["class_doc"], r["class_at"]) for r in found}
    assert got == {k: v for k, v in want.items() if many[v] > 1} and len(got) >= 21
    kept = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs(spark, rows)).collect()}
    assert kept == dict(rows)  # short notices stay: a decision of the removal
    cut = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs(spark, rows), least_cut=1).collect()}
    assert all(x in cut[0].split("\n") and x not in cut[i].split("\n") for i in (1, 2) for x in short)
    block = [prose(rng, 15) for _ in range(4)]
    rows = [(1, "\n".join([prose(rng, 9), *block])), (2, "\n\n".join([*block, prose(rng, 9)])), (3, block[0] + "\n" + prose(rng, 30))]
    cut = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs(spark, rows)).collect()}
    assert cut[1] == rows[0][1] and cut[3] == rows[2][1] and not any(x in cut[2] for x in block)  # short lines in a row are one passage


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(41)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (2, edited(rng, a, 1)), (3, edited(rng, b, 1)), (4, c), (4, None)]
    found = paragraphs.similar_paragraphs(docs(spark, rows)).collect()
    assert {r["doc"] for r in found if r["removed"]} == {2, 3}
    got = {r["doc"]: r["component_id"] for r in jaccard_join.similar_components(docs(spark, rows), k=5, percent=80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_recall_of_bands(spark):
    rng, pairs = random.Random(51), []
    for i in range(300):
        base = prose(rng, rng.randrange(45, 110))
        other = edited(rng, base, rng.randrange(1, 3))
        x, y = sets_of(base, 5), sets_of(other, 5)
        if 100 * len(x & y) >= 80 * len(x | y):
            pairs.append((base, other))
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    found = {r["doc"] for r in paragraphs.similar_paragraphs(docs(spark, rows)).collect() if r["removed"]}
    assert len(pairs) > 100 and len(found & {2 * i + 1 for i in range(len(pairs))}) >= 0.98 * len(pairs)


def test_crowded_buckets(spark):
    """Copies of one original that are near it but not each other, and copies of copies: components as by brute force."""
    rng = random.Random(61)
    base = prose(rng, 70)
    star = [base] + [edited(rng, base, 1) for _ in range(60)]
    walk = [prose(rng, 70)]
    for _ in range(40):
        walk.append(edited(rng, rng.choice(walk), 1))
    texts = [*star, *walk]
    rng.shuffle(texts)
    want = brute_components({i: sets_of(t, 5) for i, t in enumerate(texts)}, 80)
    got = {r["doc"]: r["component_id"] for r in jaccard_join.similar_components(docs(spark, enumerate(texts)), k=5, percent=80).collect()}
    assert got == want
    lines = {(r["doc"]): r["class_doc"] for r in paragraphs.similar_paragraphs(docs(spark, enumerate(texts))).collect()}
    assert sum(lines.get(i, i) == want[i] for i in want) >= 0.99 * len(texts)


def test_band_tuning():
    rows, bands = paragraphs.tune_bands(80)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and 1 - (1 - 0.4**rows) ** bands <= 0.31


# 7: decontamination


def test_canonical():
    c, names = decontaminate.canonical([b"Tom has 12 apples. He met Mary Ann at 3.5 km or 4km from Paris!\nBut 5% of (Them) \xe2\x80\x94 go for 1 000.", b"km Bob 5", None, b""])
    surfaces = lambda c: [x for x in c.slots(0, len(c.kinds)) if x]
    assert surfaces(c) == ["12", "mary ann", "3.5", "km", "4", "km", "paris", "5%", "them", "1000", "bob", "5"]
    assert surfaces(names) == ["tom", "12", "he", "mary ann", "3.5", "km", "4", "km", "paris but", "5%", "them", "1000", "bob", "5"]
    assert len(c.bounds) == 5 and c.bounds[-1] == c.bounds[-3]


def brute_contaminated(text, item):
    """Whether some 8-word windows of the item, in order in both texts, cover 0.6 of its words (words only)."""
    w, v = words_of(text), words_of(item)
    size = min(8, len(v))
    hits = [(p, q) for p in range(len(v) - size + 1) for q in range(len(w) - size + 1) if v[p : p + size] == w[q : q + size]]
    covered = {p + k for p, _ in hits for k in range(size)}
    return len(covered) >= 0.6 * len(v)


def test_contaminated_by_brute_force(spark):
    rng = random.Random(71)
    items = [(i, prose(rng, rng.choice([5, 12, 22, 40, 70]))) for i in range(12)]
    rows = []
    for i in range(60):
        w = words_of(rng.choice(items)[1])
        kind = i % 5
        if kind == 1:  # some words more in the middle
            w[len(w) // 2 : len(w) // 2] = words_of(prose(rng, rng.randrange(1, 4)))
        elif kind == 2:
            w = w[: max(1, int(len(w) * rng.choice([0.4, 0.55, 0.65, 0.8])))]
        elif kind == 3:
            w[rng.randrange(len(w))] = "other"
        elif kind == 4:
            w = []
        rows.append((i, prose(rng, rng.randrange(0, 60)) + " " + " ".join(w) + " " + prose(rng, rng.randrange(0, 60))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc"], r["item"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    want = {(d, i) for d, t in rows for i, x in items if brute_contaminated(t, x)}
    assert got == want and len(want) > 30


def test_reparameterised(spark):
    item = "Tom drives 12 km to the market with 1000 apples in the old car and gives half of the apples to Mary who pays 30 dollars for them. Tom then goes home by the same road and wants to know how many apples there are in the car"
    forms = [item, item.replace("Tom", "Mary Ann").replace("Mary who", "Jim who"), item.replace("12 km", "7km"), item.replace("1000", "2 500"), item.replace("to the market", "to the very small market"), item.replace("Tom then", "Robert then").replace("Tom drives", "Robert drives")]
    wrong = item.replace("Tom then goes home", "Peter then walks off").replace("Tom", "Ann").replace("12 km", "car 12").replace("Mary who pays 30", "nobody but pays a 30")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rng = random.Random(81)
    rows = [(i, prose(rng, 20) + ". " + t + " " + prose(rng, 20)) for i, t in enumerate(forms)] + [(100, wrong[:90] + prose(rng, 40)), (101, prose(rng, 200))]
    got = {r["doc"]: r["changed"] for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == set(range(len(forms))) and got[0] == 0 and got[1] == 2 and got[4] == 0 and got[5] == 1


def brute_slots(text, item):
    """Whether windows of the item, equal word for word or with numbers and inner names changed by one map, cover 0.6 of it in order."""
    forms = lambda t: [("<num>" if re.fullmatch(r"\d+", w) else "<name>" if re.fullmatch("[A-Z][a-z]+", w) else w, w) for w in words_of(t)]
    w, v, best = forms(text), forms(item), 0
    for shift in range(-len(v), len(w)):  # copies here have as many words as the item
        hits = [p for p in range(len(v) - 7) if 0 <= p + shift <= len(w) - 8 and [x[0] for x in v[p : p + 8]] == [x[0] for x in w[p + shift : p + shift + 8]]]
        pairs = lambda p: [(v[p + k], w[p + k + shift][1]) for k in range(8) if v[p + k][0][0] == "<"]  # noqa: B023, E731
        votes = collections.defaultdict(collections.Counter)
        for p in hits:
            for (_, a), b in set(pairs(p)):
                votes[a][b] += 1
        to = {a: min(c, key=lambda b: (-c[b], b != a, b)) for a, c in votes.items()}  # noqa: B023
        for good in ([p for p in hits if all(a == b for (_, a), b in pairs(p))], [p for p in hits if all(a == b for (_, a), b in pairs(p)) or all(to[a] == b for (_, a), b in pairs(p))]):
            inside = sorted({p + k for p in good for k in range(8)})
            changed = any(a != b for p in good for (_, a), b in pairs(p))
            plain = sum(v[k][0][0] != "<" for k in inside)
            best |= len(inside) >= 0.6 * len(v) and plain > 0 and (not changed or 2 * plain >= len(inside))
    return bool(best)


def test_slots_by_brute_force(spark):
    rng = random.Random(91)
    names, low = ["Tom", "Mary", "Ann", "Bob", "Kim", "Eva"], lambda: rng.choice(WORDS) + rng.choice(WORDS)
    item_words = lambda: [low() if k == 0 or rng.random() < 0.75 else rng.choice([str(rng.randrange(3, 30)), rng.choice(names)]) for k in range(rng.choice([14, 22, 35]))]

    def apart(words):  # two slots in a row would be one
        return [low() if k and re.match("[A-Z0-9]", w) and re.match("[A-Z0-9]", words[k - 1]) else w for k, w in enumerate(words)]

    items = [(i, " ".join(apart(apart(item_words())))) for i in range(20)]
    rows = []
    for i in range(500):
        w = words_of(rng.choice(items)[1])
        slots = [k for k, x in enumerate(w) if re.match("[A-Z0-9]", x)]
        kind = i % 5
        if kind == 1 and slots:  # one map
            to = {x: str(rng.randrange(100, 200)) if x.isdigit() else rng.choice(["Zoe", "Leo", "Ida"]) for x in {w[k] for k in slots}}
            w = [to.get(x, x) for x in w]
        elif kind == 2 and slots:  # values at random
            for k in rng.sample(slots, rng.randrange(1, len(slots) + 1)):
                w[k] = str(rng.randrange(300, 400)) if w[k].isdigit() else rng.choice(["Zoe", "Leo", "Ida"])
        elif kind == 3:
            w[rng.randrange(len(w))] = "other"
        elif kind == 4:
            w = [low() for _ in w]
        rows.append((i, " ".join([low() for _ in range(rng.randrange(1, 30))] + w + [low() for _ in range(rng.randrange(1, 30))])))
    got = {(r["doc"], r["item"]) for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in rows for i, x in items if brute_slots(t, x)}
    assert got == want and len(want) > 250 and not any(d % 5 == 4 for d, _ in got)  # clean texts are left alone


def test_contaminated(spark):
    item = "A farmer in Kansas sells 12 kg of apples to Mary for 30 dollars and then Mary gives 12 kg back to the farmer so how many apples has Mary"
    changed = item.replace("12 kg", "45 kg").replace("30", "7").replace("Mary", "Helen")
    wrong = item.replace("12 kg", "45 kg", 1)  # one slot, two values: the windows without it are enough
    typo = item[::-1].replace("yraM", "yraN", 1)[::-1]
    bench = spark.createDataFrame([(1, item), (2, "tiny words here"), (3, None), (4, "1 2 3 4 5 6 7 8 9 10"), (5, ""), (1, item)], "item_id long, text string").withColumn("doc", F.lit(0))
    rng = random.Random(5)
    rows = [(1, prose(rng, 30) + "\n" + item + "\n" + prose(rng, 20)), (2, changed), (3, wrong), (4, prose(rng, 100)), (5, None), (6, ""), (7, "see tiny words here now"), (8, "5 6 7 8 9 10 11 12 13 14 15"), (1, item), (9, typo), (10, prose(rng, 12) + " " + changed.replace("45 kg", "46 kg", 1).replace("Helen for 7", "Ann for 8") + " " + changed)]
    got = {(r["doc"], r["item"]): r["changed"] for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 2), (9, 1), (10, 1)} and got[(1, 1)] == got[(3, 1)] == got[(9, 1)] == 0 and got[(2, 1)] == 3
    clean = decontaminate.without_contaminated(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 6, 8]
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).isEmpty()
    sifted, decontaminate.SIFT = decontaminate.SIFT, 0
    try:
        assert {(r["doc"], r["item"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()} == set(got)
    finally:
        decontaminate.SIFT = sifted


# 8 and 10: classifiers


def test_codewords():
    for k in (1, 2, 4, 7, 20):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k and set(np.unique(code)) <= {-1, 1}


def test_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    hard = docs(spark, [(-1, None), (-2, ""), (-3, "12 34 !!"), (-5, "½ ² Ⅷ ①"), (-4, "z")], False)
    model = langid.train(table.where("doc_id % 4 <> 0").unionByName(hard, True))
    found = langid.predict(table.where("doc_id % 4 = 0 AND length(text) > 100").withColumn("score", F.lit("x")), model)
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count() and found.where("score < 0 OR score > 1").isEmpty()
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(hard.where("doc_id <> -4"), model).collect()} == {-1: "und", -2: "und", -3: "und", -5: "und"}
    none = langid.train(table.limit(0))
    assert {r["lang_pred"] for r in langid.predict(hard, none).collect()} == {"und"}
    one = langid.train(table.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(table.limit(5), one).collect()} == {"en"}


def test_quality_votes(spark, sf):
    table, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet").withColumn("axes", F.lit(1)) for t in ("documents", "labels"))
    model = knn_quality.train(table, labels.where("doc_id % 3 <> 1").unionByName(labels.limit(3).withColumn("quality", F.lit(None).cast("int"))))
    found = knn_quality.score(table.unionByName(table.limit(2).withColumn("text", F.lit(None).cast("string"))), model, keep=["doc_id"])
    assert found.count() == table.count() + 2 and found.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").isEmpty()
    held = found.dropDuplicates(["doc_id"]).join(labels.where("doc_id % 3 = 1"), "doc_id").toPandas()
    good, bad = held[held["quality"] == 1]["score"].values, held[held["quality"] == 0]["score"].values
    assert (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2 > 0.9
    nothing = knn_quality.train(table, labels.limit(0))
    assert {r["score"] for r in knn_quality.score(table.limit(3), nothing).collect()} == {0.5}


# 9: chat


def test_chat(spark, tmp_path):
    rng = random.Random(6)
    hard = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard), (-7, 1, "assistant", hard), (1, 0, "system", None), (1, 2, "assistant", "é漢 \n"), (1, 1, "user", ""), (2, 0, None, '"<turn role="assistant">\n'), (2, 0, None, '"<turn role="assistant">\n'), (None, 5, "assistant", " lead and trail "), (3, 0, "assistant", ""), (4, None, "assistant", "\\l\\q\\\\"), (4, 1, "assistant", "next")]
    rows += [(10 + c, t, rng.choice(["user", "assistant"]), prose(rng, rng.randrange(0, 80))) for c in range(20) for t in range(rng.randrange(1, 6))]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r["conv_id"]: r for r in chat.read_back(chat.write_formatted(df, BPE_JSON, f"file://{tmp_path}/chat")).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        twice = lambda x: len(x) + sum(ch in '\\<"' for ch in x)
        assert r["formatted_chars"] == sum(24 + twice(role) + twice(x) for *_, role, x in turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for *_, role, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.write_formatted(df.limit(0), BPE_JSON)).isEmpty()
