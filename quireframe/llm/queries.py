"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.llm import ann, bpe, chat, hard_negatives, host_quality, mixing, near_duplicates, packing, periodic_runs, quality_classifier, sharding, token_table, warc

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = host_quality.score_documents(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digests(warc.archive_pages(_table(spark, sf_dir, "pages")))


def op5_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.document_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op8_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_heap_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    digests = chat.digest_conversations(rows.unionByName(extra))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return token_table.digest_documents(token_table.decode_documents(token_table.encode_documents(_table(spark, sf_dir, "documents"), path), path))


def op12_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = hard_negatives.mine(hard_negatives.relabelled(_table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_runs(periodic_runs.document_runs(periodic_runs.with_repeats(_table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_host_quality, op2_sampled_splitters, op3_adaptive_scan, op4_warc_transactions, op5_concat_and_cut, op6_parity_sketch_join, op7_pivotal_mix, op8_compression_classifier, op9_heap_bpe_counts, op10_incremental_chat, op11_distinct_words, op12_bit_sliced_negatives, op13_periodic_runs)
}

SQL: dict[str, str] = {
    # Counts and verdict; the host rate is shrunk by the prior that the method of moments gives.
    "op1_host_quality": r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), grams AS (
  SELECT rid, i, hash5, count(*) OVER (PARTITION BY rid, hash5) AS n
  FROM (SELECT rid, i, array_to_string(list_slice(words, i, i + 4), ' ') AS hash5
        FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w))
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i, unnest(range(0, 5)) AS k FROM grams WHERE n > 1) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (rid)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source
), s AS (
  SELECT sum(n)::DOUBLE AS n, sum(f) / sum(n) AS mean, count(*) AS hosts,
         sum(n * (f / n) * (f / n)) AS sq, sum(n::DOUBLE * n) AS nn FROM h
), s2 AS (
  SELECT *, mean * (1 - mean) AS noise,
         (greatest(sq / n - mean * mean, 0) - mean * (1 - mean) * (hosts - 1) / n) / greatest(1 - nn / (n * n), 1e-12) AS spread FROM s
), p AS (
  SELECT mean, CASE WHEN spread > 0 AND noise > spread THEN noise / spread - 1 ELSE n / hosts END AS weight FROM s2
), v AS (
  SELECT source, (f + mean * weight) / (n + weight) <= 0.5 AS host_kept FROM h, p
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed) AND host_kept AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source""",
    # Every anchor's products with all rows; a list of whole numbers below 2^53 has an exact inner product of doubles.
    "op12_bit_sliced_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label AS anchor_label, b.rid AS other, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid
), p AS (
  SELECT rid, anchor_id, anchor_label, other AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.rid = s.rid AND s.label <> p.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.rid, positive ORDER BY score DESC, vec_id, other)
QUALIFY row_number() OVER w <= 3""",
}
