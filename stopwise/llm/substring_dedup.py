"""Operator 1: remove passages of many words that occur more than once.

Windows of `window` consecutive words are partitioned as super-k-mers; in a bucket they
are sorted by hash and equal neighbours compared byte by byte, so counts are exact.
Every occurrence of a repeated window is removed, whether in one text or in several.

Defined cases: null text counts as no words and comes back as an empty kept text; texts
shorter than a window are kept whole; repeated rows repeat their windows, so they lose
them; null or repeated doc_id is allowed (rows are told apart by id and text); other
columns, whatever their names, travel in the struct `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm import superkmers as sk
from stopwise.llm import vectors as v
from stopwise.llm.cluster import prepare

WINDOW = 35
GRAM = 4


def word_tokens(data: np.ndarray, offsets: np.ndarray, gram: int) -> sk.Tokens:
    words = v.words(data, offsets)
    place = np.arange(len(words.start)) - words.first[words.doc]
    return sk.Tokens(words.data, words.start, words.length, words.doc, place, v.Rolling(words.hashes()).windows(gram))


def scheme(window: int) -> sk.Scheme:
    return sk.Scheme(word_tokens, window, min(GRAM, window), keep_first=False, rare=8)


def repeated_windows(bucket: sk.Bucket, window: int) -> sk.Spans:
    """Word spans of the windows that the bucket holds twice or more."""
    ends = bucket.start + bucket.size
    words = v.words(bucket.data, np.concatenate([[0], ends]))
    # Windows in the order of the strings: string, and number of the first word.
    string = np.repeat(np.arange(len(bucket.windows)), bucket.windows)
    nth = np.arange(len(string)) - np.repeat(np.cumsum(bucket.windows) - bucket.windows, bucket.windows)
    first = words.first[string] + nth
    hashes = v.Rolling(words.hashes()).windows(window)[first]
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    begin, size = v.runs(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    leader = order[np.repeat(begin, size)]
    many = np.repeat(size, size) > 1
    one, other = order[many], leader[many]
    by_place = np.argsort(one, kind="stable")
    one, other = first[one[by_place]], first[other[by_place]]
    # A pair that goes on from the pair before it differs from it in the last word only.
    goes_on = np.concatenate([[False], (one[1:] == one[:-1] + 1) & (other[1:] == other[:-1] + 1)]) if len(one) else np.zeros(0, bool)
    at, to = one + np.where(goes_on, window - 1, 0), other + np.where(goes_on, window - 1, 0)
    left, size_left = words.start[at], words.start[one + window - 1] + words.length[one + window - 1] - words.start[at]
    right, size_right = words.start[to], words.start[other + window - 1] + words.length[other + window - 1] - words.start[to]
    equal = np.array_equal(size_left, size_right) and v.same_slices(words.data, left, right, size_left)
    if equal:
        group = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        total = np.bincount(group, 1 + bucket.repeated[string[order]])
        flags = np.zeros(len(string), bool)
        flags[order] = total[group] > 1
    else:  # two windows share a hash: count the words themselves
        texts = [words.join(f, f + window) for f in first.tolist()]
        counts: dict[bytes, int] = {}
        for text, more in zip(texts, bucket.repeated[string].tolist()):
            counts[text] = counts.get(text, 0) + 1 + more
        flags = np.fromiter((counts[text] > 1 for text in texts), bool, len(texts))
    breaks = np.concatenate([[True], string[1:] != string[:-1]])
    starts = np.flatnonzero(flags & (breaks | ~np.concatenate([[False], flags[:-1]])))
    stops = np.flatnonzero(flags & np.concatenate([breaks[1:] | ~flags[1:], [True]]))
    own = string[starts]
    return bucket.id[own], bucket.print[own], bucket.place[own] + nth[starts], bucket.place[own] + nth[stops] + window


def source_left(data: np.ndarray, offsets: np.ndarray, words: v.Words, gone: np.ndarray) -> list[bytes]:
    """The texts without the removed words and the white space behind each."""
    after = np.append(words.origin[1:], 0)
    last = words.first[1:][np.diff(words.first) > 0] - 1
    after[last] = offsets[1:][words.doc[last]]
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, words.origin[gone], 1)
    np.add.at(edge, after[gone], -1)
    stay = np.cumsum(edge[:-1]) == 0
    at = np.concatenate([[0], np.cumsum(stay)])[offsets]
    kept = data[stay]
    return [kept[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist())]


def remove_repeats(docs: DataFrame, window: int = WINDOW, spacing: bool = False) -> DataFrame:
    """Each row of docs as `row`, with doc_id, n_words, n_removed and kept_text.

    kept_text has the kept words joined by one space or, with spacing, as they stood.
    """
    prepare(docs.sparkSession)
    plan, texts = scheme(window), sk.keyed(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in v.pieces(batch):
                source, offsets = v.utf8(part.column("text"))
                words = v.words(source, offsets)
                gone = sk.covered(part, words.first)
                n_words = np.diff(words.first)
                total = np.concatenate([[0], np.cumsum(gone)])
                n_removed = total[words.first[1:]] - total[words.first[:-1]]
                if spacing:
                    texts = source_left(source, offsets, words, gone)
                else:
                    stay = np.flatnonzero(~gone)
                    data = v.gather(words.data, words.start[stay], words.length[stay] + 1)
                    sizes = np.concatenate([[0], np.cumsum(np.where(gone, 0, words.length + 1))])[words.first]
                    texts = [data[a : max(z - 1, a)].tobytes() for a, z in zip(sizes[:-1].tolist(), sizes[1:].tolist())]
                yield pa.record_batch([part.column("_row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept_text"])

    joined = sk.with_spans(docs, sk.settled(sk.repeated_spans(sk.pack(texts, plan, sk.frequent_grams(texts, plan)), lambda bucket: repeated_windows(bucket, window))))
    out = T.StructType([T.StructField("row", joined.schema["_row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(keep, out).select("row", F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_text")
