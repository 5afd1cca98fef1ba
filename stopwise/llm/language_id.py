"""Operator 4: language identification by bit-sliced Bloom filters of n-grams.

For each n-gram of a text three hashed places of one table are read and combined by AND;
the bits that stay on are the languages whose filters hold the n-gram. A language's
filter takes the n-grams that are frequent among its training documents and not far more
frequent elsewhere. The popcount of each language, as a share of the text's n-grams and
corrected for its filter's false positives, decides; the score is its share of the sum.

Training. From rows with a language that are not held out, about SAMPLE documents of each
language are taken, those whose hashes of the id are small enough; at most GRAMS n-grams of each language enter the table, whose size is fixed. It is the only thing sent
to every task: TABLE times one byte for each eight languages. Counting is done by Spark.

Defined cases: null text, or one without a letter, is `und` with score 0; a text too short
for an n-gram, or with none that is known, gets the first language by name with score 0;
without training rows all texts are `und`; a null doc_id is not held out and not learnt
from; repeated rows get the same answer; columns other than doc_id, text and lang are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm import vectors as v
from stopwise.llm.cluster import prepare, stored

N = 5  # bytes of an n-gram
SAMPLE = 1000
GRAMS = 40_000
TABLE = 1 << 21
HASHES = 3
RIVAL = 4.0  # a language keeps an n-gram unless another has it this many times as often
UNKNOWN = "und"

# Every byte that is not part of a word, as a space.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased texts, and the row of each."""
    data, offsets = v.utf8(pc.utf8_lower(column))
    data = PLAIN[data]
    count = max(len(data) - N + 1, 0)
    value = np.zeros(count, np.uint64)
    for step in range(N):
        value = (value << np.uint64(8)) | data[step : step + count]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = row[:count] == row[N - 1 :][:count]
    return v.mix(value[inside]), row[:count][inside]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def frequent_grams(docs: DataFrame) -> tuple[list[str], list[tuple[int, int]]]:
    """Languages, and (gram, language number) of what enters the filters; both bounded by the parameters."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # A share of each language that gives about SAMPLE documents: those with the smallest hashes.
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return [], []
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SAMPLE / n))])
    place = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5).alias("_place")
    sample = usable.filter(place < F.element_at(shares, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in v.pieces(batch):
                gram, row = grams(part.column("text"))
                langs, number = np.unique(np.asarray(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                for i, lang in enumerate(langs):
                    own = number[row] == i
                    pair = np.unique(np.stack([gram[own].view(np.int64), row[own].astype(np.int64)]), axis=1)
                    found, n = np.unique(pair[0], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    # Every language has about as many sampled documents as its size allows.
    chosen = {lang: min(n, SAMPLE) for lang, n in sizes.items()}
    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1")
    rated = counts.withColumn("_rate", F.col("n") / F.element_at(F.create_map(*[F.lit(x) for item in chosen.items() for x in item]), F.col("lang")))
    best = rated.groupBy("gram").agg(F.max("_rate").alias("_best"))
    own = stored(rated.join(best, "gram").filter(F.col("_rate") * RIVAL >= F.col("_best")).select("lang", "gram", "n"), "grams")
    # The least count by which a language has no more than GRAMS.
    least: dict[str, int] = {}
    room: dict[str, int] = {}
    for r in own.groupBy("lang", "n").count().orderBy("lang", F.desc("n")).collect():
        if room.setdefault(r.lang, GRAMS) >= r["count"]:
            room[r.lang] -= r["count"]
            least[r.lang] = r.n
        else:
            room[r.lang] = -1
    langs = sorted(sizes)
    if not least:
        return langs, []
    bounds = F.create_map(*[F.lit(x) for item in least.items() for x in item])
    return langs, [(r.gram, langs.index(r.lang)) for r in own.filter(F.col("n") >= F.element_at(bounds, F.col("lang"))).collect()]


def places(gram: np.ndarray) -> list[np.ndarray]:
    bits = np.uint64(TABLE.bit_length() - 1)
    return [((gram >> (bits * np.uint64(i))) & np.uint64(TABLE - 1)).astype(np.int64) for i in range(HASHES)]


def build(langs: list[str], members: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The table, a byte row of language bits at each place; and each filter's rate of false positives."""
    table = np.zeros((-(-max(len(langs), 1) // 8), TABLE), np.uint8)
    gram = np.array([g for g, _ in members], np.int64).view(np.uint64)
    lang = np.array([n for _, n in members], np.int64)
    for place in places(gram):
        np.bitwise_or.at(table, (lang // 8, place), (1 << (lang % 8)).astype(np.uint8))
    filled = [np.count_nonzero(table[i // 8] >> (i % 8) & 1) / TABLE for i in range(len(langs))]
    return table, np.array(filled) ** HASHES


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    spark = docs.sparkSession
    prepare(spark)
    langs, members = frequent_grams(docs)
    table, false = build(langs, members)
    shared = spark.sparkContext.broadcast((langs, table, false))
    bit = (np.arange(256)[:, None] >> np.arange(8)) & 1

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, false = shared.value
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            for part in v.pieces(batch):
                text = part.column("text")
                gram, row = grams(text)
                at, n = places(gram), part.num_rows
                hits = np.zeros((n, 8 * len(table)))
                for i, lane in enumerate(table):
                    mask = lane[at[0]]
                    for place in at[1:]:
                        mask = mask & lane[place]
                    hits[:, 8 * i : 8 * i + 8] = np.bincount(row.astype(np.int64) * 256 + mask, minlength=n * 256).reshape(n, 256) @ bit
                total = np.maximum(np.bincount(row, minlength=n), 1)[:, None]
                sure = np.maximum((hits[:, : len(langs)] / total - false) / np.maximum(1 - false, 1e-9), 0)
                whole = sure.sum(axis=1)
                best = sure.argmax(axis=1) if len(langs) else np.zeros(n, np.int64)
                score = sure[np.arange(n), best] / np.maximum(whole, 1e-300) if len(langs) else np.zeros(n)
                lettered = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
                said = np.where(lettered, best, len(langs)) if len(langs) else np.zeros(n, np.int64)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(names[said], pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(docs["doc_id"], held_out().alias("held_out"), docs["text"]).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
