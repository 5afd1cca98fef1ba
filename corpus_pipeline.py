"""From documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but
the last return the columns of documents. Where a stage takes part of a text away, n_chars
is made to fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import decontaminate, near_dedup, packing, quality_rules, substring_dedup
from stopwise.llm.cluster import stored

SHINGLE = 5  # words


def with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents from the struct `row`, with another text and its length."""
    own = {"text": F.col(text), "n_chars": F.when(F.col(text).isNotNull(), F.length(text)).cast("long")}
    return rows.select(*[own.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; documents that fail the rules or are left with little go."""
    rows = quality_rules.judged(docs).filter("kept")
    return with_text(rows, docs.columns, "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that with the smallest doc_id, and of several such the one with the least hash."""
    gone = near_dedup.grouped(docs.select("doc_id", "text"), size=SHINGLE).filter("NOT stays").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), "_print").distinct()
    # The input's own columns travel in a struct, whatever they are called.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"], F.lit(0)).cast("long").alias("_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("_print"))
    return rows.join(gone, ["_id", "_print"], "left_anti").dropDuplicates(["_id", "_print"]).select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go."""
    return with_text(substring_dedup.remove_repeats(docs, spacing=True), docs.columns, "kept_text")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into token sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("decontamination", benchmark_leaks), ("packing", sequences)]

# Tokens and similarities have no form in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
