"""Operator 13: draw documents whose hashed n-grams resemble a target's.

A batch's texts are joined with a sentinel between them. One pass of a pattern finds every
word of the whole batch; a search of the words' places in the texts' offsets tells which
text each is in, and n-grams whose ends lie in different texts are masked before the
buckets are counted. A feature's checksum is carried on from that of the n-gram one word shorter.

Counts of all source and of all target texts become one gain for each bucket. A document
weighs the sum of its features' gains; noise drawn from its id (Gumbel) makes the highest
scores a sample without replacement. Ranks come from one sort by ranges: each row's place in
its range plus the number of rows in earlier ranges.

Defined cases: a text that is null, empty or without words has no feature and weight 0; an empty
source gives no rows, an empty target counts 0 in each bucket; a null doc_id draws the noise of
`<seed>:` and comes after all others of its score; rows with the same id are ranked by weight,
features and then in any order; bytes that are no UTF-8 count as word characters; other columns are left out. Held at
once: a slice of SLICE bytes or one text, the buckets' counts, one gain for each bucket.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.cluster import prepare, stored

ORDER = 1  # longest n-gram
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SLICE = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")  # after lower-casing; of UTF-8, all beyond ASCII
SENTINEL = b"\n"  # no word character


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about SLICE bytes each."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def features(texts: list[bytes], order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of each feature of the texts, and the number of words of each text."""
    joined = SENTINEL.join(texts).lower()  # of bytes: A-Z only
    spans = np.fromiter(chain.from_iterable(m.span() for m in WORD.finditer(joined)), np.int64).reshape(-1, 2)
    offsets = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=offsets[1:])
    owner = np.searchsorted(offsets, spans[:, 0], "right") - 1
    words = [joined[a:b] for a, b in spans.tolist()]
    codes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    owners, found = [owner], [codes % buckets]
    for n in range(2, order + 1):
        codes = np.fromiter((zlib.crc32(word, zlib.crc32(b" ", code)) for word, code in zip(words[n - 1 :], codes.tolist())), np.int64, max(0, len(words) - n + 1))
        whole = owner[: len(codes)] == owner[n - 1 :][: len(codes)]
        owners.append(owner[: len(codes)][whole])
        found.append(codes[whole] % buckets)
    return np.concatenate(owners), np.concatenate(found), np.bincount(owner, minlength=len(texts))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of all features of a table's `text`; each task sends one row for each of its buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found = _texts(batch)
            for start, end in slices(found):
                total += np.bincount(features(found[start:end], order, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    prepare(texts.sparkSession)
    parts = texts.select(texts["text"].cast("string")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, rounded down."""
    all_source, all_target = sum(source.values()), sum(target.values())
    held = [(target.get(b, 0), source.get(b, 0)) for b in range(buckets)]
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets)))) for t, s in held], np.int64)


def scored(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""
    counts = [{row.bucket: row.n for row in bucket_counts(table, order, buckets).collect()} for table in (docs, target)]  # at most `buckets` rows
    gain = docs.sparkSession.sparkContext.broadcast(gains(*counts, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _texts(batch)
            for start, end in slices(found):
                owner, bucket, words = features(found[start:end], order, buckets)
                many = np.bincount(owner, minlength=end - start)
                weight = np.bincount(owner, gain.value[bucket], end - start).astype(np.int64)  # whole numbers: exact
                yield pa.record_batch([batch.column("doc_id").slice(start, end - start), pa.array(words), pa.array(many), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def resampled(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with its score; `rank` counts those drawn, `percent` of all with at least `least_words` words."""
    rows = stored(scored(docs, target, order, buckets, seed), "scored")
    able = F.col("n_words") >= least_words
    most = percent * rows.filter(able).count() // 100
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    ordered = stored(rows.filter(able).orderBy(*keys).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    sizes = ordered.groupBy("_range").count().orderBy("_range").collect()  # a row for each range
    before, starts = 0, []
    for row in sizes:
        starts.append((row["_range"], before))
        before += row["count"]
    starts = docs.sparkSession.createDataFrame(starts, "_range int, _before long")
    place = F.col("_before") + F.col("_place") + 1
    ranked = ordered.join(F.broadcast(starts), "_range").withColumn("rank", F.when(place <= most, place))
    return ranked.select(*rows.columns, "rank").unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")))


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# SQL has no crc32: the table of its 256 steps is built, then every different word is folded byte by byte.
SQL = f"""
WITH steps AS (SELECT list(step ORDER BY i) AS steps FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS step FROM range(256) t(i))),
source AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS words FROM documents),
target AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS words FROM benchmark),
source_words AS (SELECT r, unnest(words) AS word FROM source),
target_words AS (SELECT unnest(words) AS word FROM target),
buckets AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex) // 2), lambda k: ('0x' || hex[2 * k + 1 : 2 * k + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c & 255, b) + 1)::INT]))) % {BUCKETS} AS bucket
  FROM (SELECT word, lower(hex(encode(word))) AS hex FROM (SELECT word FROM source_words UNION SELECT word FROM target_words)), steps),
s AS (SELECT bucket, count(*) AS s FROM source_words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::BIGINT + {BUCKETS}) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::BIGINT + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM source_words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM source LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {LEAST_WORDS}
"""
