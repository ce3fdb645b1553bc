"""The queries of this folder: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversation_repair, exact_dedup, minhash, packing, quality, secret_scan, sentencepiece_nbest, simhash, token_counts, token_orc, toxicity, warc_zip


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    """A doc_id that is null has no remainder and counts as not held out."""
    out = F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return _judged(toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir))), 0.5)


def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_nbest.digest_nbest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), n=4)


def op3_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return _judged(quality.score(docs, quality.train(docs, labels(spark, sf_dir))), 0.3)


def op4_secrets(spark, sf_dir):
    return secret_scan.scan(documents(spark, sf_dir), secret_scan.Scanner())


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.decide(documents(spark, sf_dir))


def op6_token_orc(spark, sf_dir):
    return token_orc.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_simhash(spark, sf_dir):
    found = simhash.components(documents(spark, sf_dir), words=4, bits=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_minhash(spark, sf_dir):
    return minhash.fingerprints_beside_next(documents(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)


def op11_alignment(spark, sf_dir):
    return alignment.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_repair(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.digest_all(conversations, conversation_repair.damage(conversations))


def op13_warc(spark, sf_dir):
    return warc_zip.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_quality, op4_secrets, op5_exact_dedup, op6_token_orc, op7_simhash, op8_minhash, op9_token_counts, op10_packing, op11_alignment, op12_repair, op13_warc)}

#: Ways over a turn that stays: its initial (o: any other), the last initial before (-: none) and after, cost, edits, the turn inserted, a new role.
_STAYS = ", ".join(
    f"('{initial}', '{p}', '{to}', {2 * (between != '') + 2 * (role != '')}, '{'I' * (between != '')}{'R' if role else 'K'}', '{between}', '{role}')"
    for initial in "suao"
    for p in "-sua"
    for to, role in (("s", ""), ("u", ""), ("a", ""), ("u", "user"), ("a", "assistant"))
    for between in [("" if (p == "u") == (to == "a") else "assistant:" if p == "u" else "user:") if to != "s" else ""]
    if (role or initial == to) and (to != "s" or p == "-")
)

ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]', '', 'g')) AS text_sha256 FROM documents),
             k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
    """,
    "op12_repair": f"""
        WITH RECURSIVE
             t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
             c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                          xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f
                   FROM conversations, t),
             d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                          unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS k
                   FROM c WHERE f <> 0),
             n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS i FROM d),
             e AS (SELECT conv_id, turn, i, role, text, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
                          CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                               WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '-' END AS fault,
                          lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
                   FROM n),
             w(initial, p, s, cost, edits, between, role) AS (VALUES {_STAYS}),
             r AS (SELECT conv_id, 0::BIGINT AS i, '-' AS s, 0::BIGINT AS cost, '' AS audit, '' AS rep FROM (SELECT DISTINCT conv_id FROM e)
                   UNION ALL
                   SELECT conv_id, i, s, cost, audit, rep FROM (
                       SELECT e.conv_id, e.i, x.s, r.cost + x.cost + CASE WHEN x.edits <> 'D' AND e.fault = 't' THEN 1 ELSE 0 END AS cost, r.audit || x.edits AS audit,
                              CASE WHEN x.edits = 'D' THEN r.rep ELSE r.rep || CASE WHEN x.between = '' THEN '' ELSE chr(10) || x.between END || chr(10) || CASE x.role WHEN '' THEN e.role ELSE x.role END || ':' || e.text END AS rep
                       FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i + 1
                       JOIN (SELECT * FROM w UNION ALL SELECT a.x, b.x, b.x, 3, 'D', '', '' FROM (VALUES ('s'), ('u'), ('a'), ('o')) a(x), (VALUES ('-'), ('s'), ('u'), ('a')) b(x)) x
                         ON x.initial = e.initial AND x.p = r.s AND (x.edits = 'D' OR e.fault NOT IN ('b', 'd')))
                   QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1),
             z(s, cost, edits, rep) AS (VALUES ('-', 0, '', ''), ('s', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 2, 'I', chr(10) || 'assistant:'), ('a', 0, '', '')),
             m AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, sum((fault = 'b')::INT) AS blank, sum((fault = 'd')::INT) AS duplicate, sum((fault = 't')::INT) AS truncated, sum((pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM e GROUP BY conv_id),
             b AS (SELECT m.*, r.cost + z.cost AS cost, r.audit || z.edits AS audit, sha256(substr(r.rep || z.rep, 2)) AS sha FROM m JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.n JOIN z ON z.s = r.s
                   QUALIFY row_number() OVER (PARTITION BY m.conv_id ORDER BY r.cost + z.cost, r.audit || z.edits) = 1)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
    "op13_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
