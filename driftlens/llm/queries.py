"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, chat, decontam, fmindex, quality, sharding, simhash, tokenfile, toxicity, urlrules
from driftlens.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.judged(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.read_back(chat.written(chat.events_of(turns)))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return x.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.judged(table(spark, sf_dir, "documents"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sharding.sharded(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return x.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_chat_formatting,
        op3_benchmark_decontamination,
        op4_quality_rules,
        op5_token_id_output,
        op6_url_filters,
        op7_substring_dedup,
        op8_bpe_encoding,
        op9_sharding,
        op10_toxicity,
    )
}
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END
           + length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '\[/?INST\]|</?s>')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

LEAK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), h AS (
  SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit) x, range(0, 10) AS o(k) WHERE k < n GROUP BY rid
), s AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""

SUBSTRING_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), twice AS (
  SELECT g FROM win GROUP BY g HAVING count(*) > 1
), cov AS (
  SELECT DISTINCT rid, i + k AS i FROM win JOIN twice USING (g), range(0, 35) AS o(k)
), kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) e ANTI JOIN cov USING (rid, i) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

ORACLE_SQL = {
    "op2_chat_formatting": CHAT_SQL,
    "op3_benchmark_decontamination": LEAK_SQL,
    "op4_quality_rules": quality.oracle(),
    "op7_substring_dedup": SUBSTRING_SQL,
}
