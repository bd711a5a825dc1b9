"""Queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, mixing, quality, topk, toxicity, url_filter
from .common import literal, table
from .line_dedup import dedup_lines
from .packing import pack
from .simhash import near_duplicates
from .token_counts import count_tokens


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), distance=4, size=4)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1024)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select cast(-7 as bigint) as conv_id, turn, role, {literal(chat.PROBE)} as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat.digests(rows.unionByName(probe))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_words=50)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048, 0)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_url_filter, op4_quality_rules, op5_token_counts, op6_chat_format, op7_source_mix, op8_line_dedup, op9_top_k, op10_best_fit_packing)}
ORACLES: dict[str, str] = {"op3_url_filter": url_filter.SQL, "op6_chat_format": chat.SQL, "op7_source_mix": mixing.SQL, "op9_top_k": topk.brute_sql()}
