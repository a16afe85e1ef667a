"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import alignment, ann, chat, imatch, minhash, packing, quality, secrets, sentencepiece_codec, substring_dedup, token_counts, warc, yinyang
from lattica.llm.common import durable, scratch_path, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels"), "quality")
    scored = quality.with_scores(documents.withColumn("held_out", quality.held_out()), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lex = imatch.lexicon(documents)
    half = F.expr("cast(n_chars div 2 as int)")
    marked = imatch.with_fingerprints(documents, lex, {"text": "fingerprint"})
    paired = imatch.with_next_text(marked, carried="fingerprint").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = paired.select(
        "doc_id",
        "n_chars",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
        "fingerprint",
        "next_fingerprint",
    )
    near = {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")}
    compared = imatch.with_fingerprints(edited, lex, {"edited": "edited_fingerprint"}, near)
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = substring_dedup.dedup(documents)
    return cleaned.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), archives)
    return warc.page_report(warc.reassembled(warc.read_records(spark, archives)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_report(table(spark, sf_dir, "documents"), limit=512)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(secrets.of_kinds("spans", kind)).cast("long")
    base = F.array_join(secrets.of_kinds("spans", "assign", "access", "hex"), ",")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), end_id=1, most=2048)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.search(rows, F.col("vec_id") % 100 == 0, k=10)


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return yinyang.with_inertia(*yinyang.cluster(rows, clusters=16, rounds=3, dimension=64, scale=64, seed=1))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(durable(chat.formatted(rows)))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_groups=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_imatch": op4_imatch,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_ann": op10_ann,
    "op11_yinyang": op11_yinyang,
    "op12_chat": op12_chat,
    "op13_alignment": op13_alignment,
}


def _clustering_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds by full scans."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (w.v[i] - c.v[i]) * (w.v[i] - c.v[i])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""far{i} AS MATERIALIZED (SELECT w.r, c.n, {square} AS far FROM w, c{i} AS c),
            own{i} AS MATERIALIZED (SELECT r, n, far FROM far{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, n) = 1)""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
                SELECT n, i, (sum(w.v[i]) - ((sum(w.v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM own{i} JOIN w USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY n, i
            ), c{i + 1} AS MATERIALIZED (
                SELECT c.n, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT n, list(m::BIGINT ORDER BY i) AS v FROM mean{i} GROUP BY n) m USING (n)
            )""")
    return f"""
        WITH w AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS n, v FROM w WHERE vec_id IS NOT NULL
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {clusters}
        ), {", ".join(steps)}
        SELECT w.vec_id, o.n::INTEGER AS cluster, o.far AS distance, (sum(o.far) OVER (PARTITION BY o.n))::BIGINT AS cluster_inertia,
               (sum(o.far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM own{rounds} o JOIN w USING (r) JOIN c{rounds} c ON c.n = o.n
    """

#: DuckDB SQL where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": """
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), places AS (
            SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0
        ), shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM places
        ), sizes AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS MATERIALIZED (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        ), components AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
        )
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM components LEFT JOIN sizes USING (doc_id)
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to,
               true AS complete
        FROM f
    """,
    "op11_yinyang": _clustering_sql(),
    "op12_chat": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), marks AS (
            SELECT *, length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
                + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS escaped,
                length(regexp_replace(role, '[^\\:\n]', '', 'g')) AS role_escaped
            FROM said
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(role) + role_escaped + length(text) + escaped + 14)::BIGINT AS formatted_chars
        FROM marks GROUP BY conv_id
    """,
}
