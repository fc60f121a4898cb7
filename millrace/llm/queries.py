"""The queries opN_* over the supplied tables, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import align, bpe, chat, decontaminate, jaccard_join, knn_quality, langid, licenses, paragraphs, ranked, repetition, token_store, warc
from millrace.llm.common import crc32_mod, small_batches, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.deduplicated(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.drop("repeat_spans")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read(spark, path, ids=False)


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), rank_file(), keep=["doc_id"], tokens=False)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.cuts(written(paragraphs.repeats(table(spark, sf_dir, "documents")), "repeats"))
    return found.withColumnRenamed("doc", "doc_id")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_components(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held))
    found = langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    found = chat.read_back(chat.write_formatted(rows, public_tokenizers.path("byte_bpe_50k.json")))
    return found.drop("n_tokens", "loss_tokens")


def op10_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(F.coalesce(crc32_mod("doc_id", 3) != 1, F.lit(False)))
    model = knn_quality.train(docs, labels)
    found = knn_quality.score(docs.withColumn("held_out", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", "predicted")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_quality_rules, op3_token_store, op4_byte_bpe, op5_paragraph_dedup, op6_jaccard_join, op7_template_decontamination, op8_language_codes, op9_chat_masks, op10_quality_neighbours, op11_ranked_search, op12_merge_path_alignment, op13_license_scan)}

_ESCAPED = "2 * length({0}) - length(replace(replace(replace({0}, '\\', ''), '<', ''), '\"', ''))"  # characters once \\, < and \" are two each

ORACLE_SQL = {
    "op9_chat_masks": f"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
                   UNION ALL SELECT -7, k, who, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(k, who))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, '' ORDER BY turn NULLS FIRST, role, body), '')) AS loss_sha256,
               CAST(sum(24 + {_ESCAPED.format('role')} + {_ESCAPED.format('body')}) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages),
             g AS (SELECT d, max(page_id) AS top FROM p WHERE b >= 1000 GROUP BY d)
        SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN top IS NOT NULL AND b >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top IS NOT NULL AND b >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM p LEFT JOIN g USING (d)""",
    "op6_jaccard_join": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [list_aggregate(ws, 'string_agg', ' ')]
                ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w WHERE ws IS NOT NULL),
        n AS (SELECT d.doc_id, coalesce(len(sh), 0) AS n FROM documents d LEFT JOIN s USING (doc_id)),
        e AS (SELECT doc_id, unnest(sh) AS g FROM s),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT x AS doc_id, any_value(n.n) AS n_shingles, min(y) AS component_id FROM reach JOIN n ON n.doc_id = x GROUP BY x""",
    "op11_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT count_if(len(ws) > 0) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
        tf AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
        df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
        q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
        m AS (SELECT r, doc_id, 50 + (50 * len(ws) * n_docs) // n_terms AS m FROM d, s WHERE len(ws) > 0),
        g AS (SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM df, s),
        x AS (SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN tf USING (w) JOIN g USING (w) JOIN m USING (r) GROUP BY item_id, doc_id, r),
        o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT * FROM o WHERE rank <= 50""",
    "op13_license_scan": licenses.oracle(),
}
