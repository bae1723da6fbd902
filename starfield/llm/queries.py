"""The queries of the corpus operators, over whole tables with production parameters, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starfield.llm import bpe, chat, classifier, contamination, importance, licenses, packing, quality_rules, repair, sharding, simhash, substrings, warc


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, conversations, benchmark, labels = map(_table, ("documents", "pages", "conversations", "benchmark", "labels"))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(conversations(spark, sf_dir))


def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op3_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(documents(spark, sf_dir))


def op4_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op8_license_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf_dir))


def op10_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classified(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    return repair.report(repair.damaged(rows), rows)


def op13_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


_ALL = (
    op1_chat_collapse, op2_positional_index, op3_seed_extend, op4_concat_cut, op5_simhash_pivots, op6_crf_lines, op7_feistel_shards,
    op8_license_seeds, op9_warc_salvage, op10_co_training, op11_importance, op12_repair, op13_distinct_words,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op1_chat_collapse": """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(coalesce(md5(role), '-') || coalesce(md5(text), '-'), '/' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM rows GROUP BY conv_id
), one AS (
  SELECT k, min(conv_id) AS conv_id, count(*) AS copies, any_value(n_turns) AS n_turns, any_value(text) AS text FROM whole GROUP BY k
)
SELECT a.conv_id, CAST(0 AS BIGINT) AS part, a.n_turns, a.copies, a.text FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n_turns > a.n_turns AND starts_with(b.k, a.k || '/'))
""",
    "op9_warc_salvage": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
""",
}
