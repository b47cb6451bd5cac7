"""The queries of the operators, each over its whole table with production parameters, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.llm import bpe_chunks, chat, html_text, knn_quality, packing, quality_rules, rabitq, rans, sharding, simhash
from tagflow.llm.common import on_all_cores, written
from tagflow.llm.tokens import column_bpe
from tagflow.sources import table
from tagflow.storage import fresh

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_all_cores(table(spark, sf_dir, "documents"))


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    folder = fresh(spark, "ids")
    rans.write_ids(documents(spark, sf_dir), folder, path, end_id=1)
    stored = rans.read_ids(spark, folder, column_bpe(path).size)
    return stored.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(on_all_cores(table(spark, sf_dir, "pages")))


def op4_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_size(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = knn_quality.train(docs, table(spark, sf_dir, "labels"))
    named = docs.select("doc_id", knn_quality.held_out(F.col("doc_id")).alias("held_out"), "text")
    return knn_quality.classify(named, model).select("doc_id", "held_out", "score", "predicted")


def op6_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digests(bpe_chunks.encode(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), decode=True))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pieces(docs, public_tokenizers.path(BYTE_BPE), end_id=1)
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    # Written first, so that sampling the ranges of lengths doesn't encode the texts once more.
    return packing.pack(written(digest), ties=("doc_id", "start", "ids_crc32", "doc_tokens"))


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op9_rotated_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
win AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(k / n) AS m, coalesce(var_samp(k / n), 0) AS v, avg(1.0 / n) AS chance FROM h),
r AS (SELECT m, CASE WHEN m * (1 - m) > 1e-12 AND chance < 1 - 1e-9 THEN (v / (m * (1 - m)) - chance) / (1 - chance) ELSE 0 END AS r FROM p),
s AS (
  SELECT source, (k + m * wt) / (n + wt) AS host_rate
  FROM h, (SELECT m, CASE WHEN r > 1.0 / 1001 THEN greatest(1.0, 1 / r - 1) ELSE 1000.0 END AS wt FROM r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) AS host_rate,
       NOT base_failed AND NOT coalesce(host_rate > 0.5, false) AS kept
FROM f LEFT JOIN s USING (source)
"""

OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         coalesce('=' || replace(replace(role, '~', '~0'), '|', '~1'), '-') || '|' || coalesce('=' || replace(replace(text, '~', '~0'), '|', '~1'), '-') || '|' AS shown,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS part
  FROM conversations),
pre AS (SELECT conv_id, k, string_agg(shown, '') OVER (PARTITION BY conv_id ORDER BY k) AS body FROM t),
whole AS (
  SELECT t.conv_id, count(*) AS n_turns, string_agg(shown, '' ORDER BY k) AS body, string_agg(part, '' ORDER BY k) AS rendered
  FROM t GROUP BY t.conv_id),
one AS (SELECT body, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY body, n_turns),
cut AS (SELECT DISTINCT body FROM (SELECT pre.body AS body, k, w.n_turns FROM pre JOIN whole w USING (conv_id)) WHERE k < n_turns)
SELECT one.conv_id, one.n_turns, one.n_copies, w.rendered
FROM one JOIN whole w ON w.conv_id = one.conv_id
WHERE one.body NOT IN (SELECT body FROM cut)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_host_rules, op2_rans_tokens, op3_html_layout, op4_best_fit_shards, op5_knn_quality, op6_chunked_bpe, op7_simhash_pigeonring, op8_nnls_packing, op9_rotated_bits, op10_snapshot_collapse)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_host_rules": OP1_SQL, "op10_snapshot_collapse": OP10_SQL}
