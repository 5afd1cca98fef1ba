"""Queries of this package and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import chat_format, decontaminate, importance, language_id, near_dedup, packing, quality_rules, sentencepieces, substring_dedup, suffix_dedup, url_filter, warc, whitening
from stopwise.llm.cluster import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.remove_later_copies(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_removed_lines")


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.digests(chat_format.with_probe(table(spark, folder, "conversations")))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages").select("page_id", "url"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.predicted(table(spark, folder, "documents").select("doc_id", "text", "lang"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, folder, "documents").select("doc_id", "text")).drop("_print")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_path(spark, "warc")
    warc.write(table(spark, folder, "pages").select("page_id", "url", "html"), archives)
    return warc.read(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.digests(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    rows = importance.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def all_queries() -> dict[str, Query]:
    return {name: query for name, query in globals().items() if name.startswith("op")}


def all_sql() -> dict[str, str]:
    return {"op10_quality_rules": quality_rules.SQL, "op2_chat_format": chat_format.SQL, "op13_resampling": importance.SQL}
