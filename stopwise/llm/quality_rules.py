"""Operator 10: lines that many documents of a host share are removed; documents that are left with little go.

Only DataFrame functions. A line is normalised (A-Z lower-cased, digits as 0, white space
collapsed) and hashed. Distinct documents of a host with that line are counted by text,
so a document and its exact copies count once; a line above the limits is boilerplate.
A document fails if too few of its words stand outside boilerplate, or by the base rules
(fewer than 50 words, or over half of them in repeated 3-word windows).

The counts are pre-aggregated before each shuffle; a hot host or line is a sum like any
other. The join of lines with the frequent ones is left to adaptive execution, which
splits a hot line. Texts themselves are not shuffled for the verdict.

Defined cases: null text has no words and fails; a null host is the host ''; repeated
rows get the same verdict each; the input's columns travel in the struct `row`, so names
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.cluster import stored

SPACE = r"[\x20\x09-\x0D]+"
MIN_DOCUMENTS = 20  # a boilerplate line is in more distinct documents of its host than this
MIN_SHARE = 0.01  # and in more than this share of them: hosts are whole datasets, so a larger share is out of reach of any line
MIN_LEFT = 0.3  # share of a document's words that must stand outside boilerplate
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text: Column) -> Column:
    """Lines with at least one word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normal(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, SPACE, " ")), UPPER + "123456789", LOWER + "000000000")


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda word: word != "")


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often body names it and wherever the plan puts it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more: equal windows are neighbours once sorted."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def covered_words(windows: Column) -> Column:
    """Words under the repeated windows of a sorted list."""
    equal = lambda x, i: F.coalesce(x["h"] == F.get(windows, i)["h"], F.lit(False))
    many = F.filter(windows, lambda x, i: equal(x, i - 1) | equal(x, i + 1))
    starts = F.array_sort(F.transform(many, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")), lambda a: a["n"])


def measured(docs: DataFrame) -> DataFrame:
    """The base figures of each row."""
    text, lines = F.coalesce("text", F.lit("")), text_lines(F.col("text"))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("_print"), F.xxhash64("text").alias("_text"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        text_words(F.col("text")).alias("_words"),
    )
    rows = rows.withColumn("n_words", F.size("_words").cast("long")).withColumn("_windows", let(F.col("_words"), repeated_words)).drop("_words")
    rows = rows.withColumn("n_repeat_words", let(F.col("_windows"), covered_words).cast("long")).drop("_windows")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """A row for each line: its document (two hashes), host, hash and number of words; one without a hash for a document without lines."""
    line = F.transform(text_lines(F.col("text")), lambda x: F.struct(F.xxhash64(normal(x)).alias("hash"), F.size(F.split(F.trim(F.regexp_replace(x, SPACE, " ")), " ")).alias("words")))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_print"), F.xxhash64("text").alias("_text"), F.coalesce(docs[host].cast("string"), F.lit("")).alias("_host"), F.posexplode_outer(line).alias("_nth", "line"))
    return rows.select("_print", "_text", "_host", F.coalesce("_nth", F.lit(0)).alias("_nth"), F.col("line.hash").alias("_hash"), F.col("line.words").alias("_line_words"))


def boilerplate(lines: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """Lines above the limits, by host."""
    counts = lines.filter("_hash IS NOT NULL").groupBy("_host", "_hash").agg(F.count_distinct("_text").alias("n")).filter(F.col("n") > min_documents)
    hosts = lines.filter("_nth = 0").groupBy("_host").agg(F.count_distinct("_text").alias("all"))
    return counts.join(hosts, "_host").filter(F.col("n") > min_share * F.col("all")).select("_host", "_hash")


def judged(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Each row of docs as `row`, with the base figures, n_removed_words, n_removed_lines, kept and kept_text."""
    lines = stored(host_lines(docs, host), "lines")  # cut and hashed once, for the counts and for the removal
    common = lines.join(boilerplate(lines, min_documents, min_share), ["_host", "_hash"])
    # Repeated rows share a name, so their words are counted as often as there are rows.
    lost = common.groupBy("_print", "_text").agg(F.sum("_line_words").alias("_lost"), F.count("*").alias("_lost_lines"), F.collect_set("_hash").alias("_hashes"))
    copies = lines.filter("_nth = 0").groupBy("_print", "_text").agg(F.count("*").alias("_copies"))
    rows = measured(docs).join(lost.join(copies, ["_print", "_text"]), ["_print", "_text"], "left")
    removed, removed_lines = (F.coalesce((F.col(c) / F.col("_copies")).cast("long"), F.lit(0)) for c in ("_lost", "_lost_lines"))
    text = F.col("row.text")
    kept_lines = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains("_hashes", F.xxhash64(normal(line))))
    return rows.select(
        "row", F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", removed.alias("n_removed_words"), removed_lines.alias("n_removed_lines"),
        F.when(F.col("base_failed"), False).otherwise(F.col("n_words") - removed >= min_left * F.col("n_words")).alias("kept"),
        F.when(F.col("_hashes").isNull(), text).otherwise(F.array_join(kept_lines, "\n")).alias("kept_text"),
    )


SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
), cut AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
), windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM cut)
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM windows), (SELECT unnest([0, 1, 2]) AS k)
  WHERE c > 1 GROUP BY rid
), lines AS (
  SELECT rid, host, text, translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '{UPPER}123456789', '{LOWER}000000000') AS line
  FROM (SELECT rid, host, text, unnest(lines) AS line FROM cut)
), hosts AS (
  SELECT host, count(DISTINCT text) AS docs FROM base GROUP BY host
), frequent AS (
  SELECT l.host, l.line FROM (SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY host, line) l JOIN hosts h ON l.host = h.host
  WHERE l.n > {MIN_DOCUMENTS} AND l.n > {MIN_SHARE}::DOUBLE * h.docs
), lost AS (
  SELECT l.rid, sum(len(string_split(l.line, ' '))) AS n, count(*) AS gone_lines FROM lines l JOIN frequent f ON l.host = f.host AND l.line = f.line GROUP BY l.rid
), figures AS (
  SELECT c.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS gone, coalesce(l.gone_lines, 0)::BIGINT AS n_removed_lines
  FROM cut c LEFT JOIN repeated r ON c.rid = r.rid LEFT JOIN lost l ON c.rid = l.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND n_words - gone >= {MIN_LEFT}::DOUBLE * n_words AS kept,
  gone AS n_removed_words, n_removed_lines
FROM figures
"""
