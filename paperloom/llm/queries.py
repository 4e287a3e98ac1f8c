"""Thin queries over the driver's tables, one per operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat, embeddings, langid, mixing, packing, quality, sharding, simhash, tokens, warc
from paperloom.llm.tables import table


def op1_embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op2_tool_call_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.turns_as_tools(table(spark, sf_dir, "conversations")), chat.REPLY_TOOLS)


def op3_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_index(warc.write_archive(table(spark, sf_dir, "pages")))


def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *byte_bpe())


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_place")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def byte_bpe() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_embedding_near_copies, op2_tool_call_chat, op3_balanced_sharding, op4_warc_archive, op5_hierarchical_packing, op6_quality_votes, op7_pfair_mixing, op8_language_id, op9_simhash_golay, op10_token_counts)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_call_chat": chat.ORACLE, "op4_warc_archive": WARC_SQL}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INTEGER), 10))::UBIGINT >> CAST(35 - 5 * (i % 8) AS UBIGINT)) % 32)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM d
"""
