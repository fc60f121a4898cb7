"""Queries of the subpackage by SQL, the libraries and brute force, and the pipeline against its own stages by brute force."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.repetition import measure
from tests.llm.test_operators import BPE_JSON, RANKS, brute_components, brute_contaminated, brute_cut, brute_cuts, brute_lines, brute_repeats, brute_spans, sets_of, words_of


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    order = sorted(range(len(found.description)), key=lambda k: found.description[k][0])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*names).collect())) == sorted(key([r[k] for k in order]) for r in found.fetchall())


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_quality_query(spark, sf, texts):
    found = {r["doc_id"]: r for r in queries.op2_quality_rules(spark, sf).collect()}
    assert set(found) == set(texts)
    for i, t in texts.items():
        r, w, lines = found[i], words_of(t), [x for x in (t or "").split("\n") if words_of(x)]
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and r["kept"] == (not r["base_failed"] and r["covered_fraction"] <= 0.5 and r["longest_repeat"] <= 200)
        if 0 < len(w) <= 250:
            hit, longest = brute_repeats(w, 8)
            assert r["longest_repeat"] == (longest if longest >= 8 else 0) and r["covered_fraction"] == pytest.approx(sum(len(w[k]) for k in hit) / sum(map(len, w)))


def test_token_store_query(spark, sf, texts):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(BPE_JSON), 0
    found = {r["doc_id"]: r for r in queries.op3_token_store(spark, sf).collect()}
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert tuple(found.pop(i))[:4] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not found


def test_byte_bpe_query(spark, sf, texts):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.bpe.ranks_of(RANKS), special_tokens={})
    for r in queries.op4_byte_bpe(spark, sf).collect():
        t = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_paragraph_query(spark, sf, texts):
    first = brute_lines(texts)
    gone = brute_cuts(texts, first)
    found = queries.op5_paragraph_dedup(spark, sf).collect()
    assert {(r["doc_id"], r["at"]) for r in found if r["kind"] == "line" and r["cut"]} == gone and {(r["doc_id"], r["at"]) for r in found if r["kind"] == "line" and not r["cut"]} == {first[k] for k in gone}
    assert {(r["doc_id"], r["at"], r["at"] + r["n_words"], r["removed"]) for r in found if r["kind"] == "stretch"} == brute_spans(texts, gone)


def test_template_query(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op7_template_decontamination(spark, sf).collect()}
    low = lambda t: " ".join(w.strip(".,;:!?").lower() for w in words_of(t))
    want = {(i, j) for i, t in texts.items() for j, x in items.items() if brute_contaminated(low(t), low(x))}
    assert found == want and found


def test_language_query(spark, sf, texts):
    rows = queries.op8_language_codes(spark, sf.replace("0.001", "0.01")).collect()
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]][0] and len(words_of(lang[r["doc_id"]][1])) >= 20]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in held) >= 0.97 * len(held) > 100
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in lang[r["doc_id"]][1] or "")) for r in rows)


def test_quality_votes_query(spark, sf):
    d = sf.replace("0.001", "0.01")
    rows = queries.op10_quality_neighbours(spark, d).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    good, bad = (np.array([r["score"] for r in rows if r["held_out"] and label.get(r["doc_id"]) == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2 > 0.9


@pytest.fixture(scope="module")
def plain(spark, sf):
    return corpus_pipeline.run(spark, sf).collect()


def test_pipeline_of_hard_tables(spark, sf, tmp_path, plain):
    """Nulls, empty texts, repeated rows and columns with clashing names; and no rows at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "x " * 80, None), (900, None, "s"), (901, "", None), (902, " \n ", "s"), (5, None, None)], "doc_id long, text string, source string")
    hard = docs.unionByName(docs.where("doc_id < 20")).unionByName(odd, True).selectExpr("*", "1 AS ids", "'a' AS doc", "2 AS kept", "3 AS n_tokens", "4 AS line")
    for name, table in (("hard", hard), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").isEmpty()
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/hard")
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got.collect()} == {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in plain}


def test_pipeline(spark, sf, plain):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    m = {i: measure(t.encode()) for i, t in docs.items()}
    kept = {i for i, x in m.items() if x[0] >= 50 and 100 * x[4] <= 50 * x[0] and x[5] <= 0.5 and x[6] <= 200}
    tops = brute_components({i: sets_of(docs[i], 5) for i in sorted(kept)}, 80)
    kept = {i for i in kept if tops[i] == i}
    kept_texts = {i: docs[i] for i in sorted(kept)}
    gone = brute_cuts(kept_texts, brute_lines(kept_texts))
    spans = brute_spans(kept_texts, gone)
    text = {i: brute_cut(i, docs[i], gone, spans) for i in kept}
    want = {i: t for i, t in text.items() if t.strip() and not any(b in " ".join(t.split()) for b in bench)}
    got = {r["doc_id"]: r["offsets"][-1] for r in plain}
    assert got == {i: len(t.encode()) for i, t in want.items()}
