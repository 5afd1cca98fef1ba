"""Operator 9: remove long byte strings that already occurred, found by merging suffix orders.

Texts are cut into super-k-mers of byte windows, so all equal windows meet in one bucket
(see superkmers.py); strings that share too little with any other one to hold a repeat
are put aside (`candidates`). In a bucket the others form shards. Each shard is sorted once and reduced
to its Burrows-Wheeler transform; the transforms are merged by refining their interleave:
one pass sorts the positions, stably, by the symbol before each suffix, so that after t
passes the suffixes stand in the order of their first t symbols. Boundaries between
differing suffixes appear in the pass that tells them apart, which is their common
prefix. No suffix of a shard is sorted again. What shares a block after `window` bytes is
a repeated interval; its earliest place (doc_id, then start) stays.

A symbol here is a group of up to five bytes, which divides the number of passes; a
string's last, shorter groups are symbols of their own, each in a block of its own.

Defined cases: null text counts as empty; texts shorter than the window are kept; matches
never cross texts; repeated rows (same doc_id and text) count as one document, so none of
them is the earlier one; rows with one doc_id but different texts are ordered by a hash of
the text; a null doc_id is ordered as 0. A cut may split a character: kept bytes are
binary. Other columns travel in the struct `row`.
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

WINDOW = 100
GRAM = 14
SHARDS = 4  # of a bucket


def byte_tokens(data: np.ndarray, offsets: np.ndarray, gram: int) -> sk.Tokens:
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    place = np.arange(len(data)) - offsets[:-1][doc]
    return sk.Tokens(data, np.arange(len(data)), np.ones(len(data), np.int8), doc, place, v.Rolling(data).windows(gram))


def scheme(window: int) -> sk.Scheme:
    return sk.Scheme(byte_tokens, window, min(GRAM, window), keep_first=True, rare=16)


def stretch_hashes(bucket: sk.Bucket, start: np.ndarray, width: int) -> np.ndarray:
    value = np.zeros(len(start), np.uint64)
    for step in range(width):
        value = value * v.BASE + bucket.data[start + step]
    return v.mix(value)


def repeated(values: np.ndarray) -> np.ndarray:
    _, group, count = np.unique(values, return_inverse=True, return_counts=True)
    return count[group] > 1


def candidates(bucket: sk.Bucket, strings: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Strings that may share a window: one that does shares the minimiser and half of the rest of the window to its left or right."""
    half = (window - gram + 1) // 2
    seed = bucket.start[strings] + bucket.seed[strings]
    found = np.zeros(len(strings), bool)
    for start in (seed - half, seed):
        inside = np.flatnonzero((start >= bucket.start[strings]) & (start + half + gram <= bucket.start[strings] + bucket.size[strings]))
        found[inside[repeated(stretch_hashes(bucket, start[inside], half + gram))]] = True
    return strings[found]


def groups(data: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """The next `width` bytes of each position as a number that orders them; a string's end comes first."""
    key = np.zeros(len(data), np.uint64)
    for step in range(width):
        shifted = np.zeros(len(data), np.uint64)
        shifted[: len(data) - step] = data[step:]
        key = (key << np.uint64(8)) | np.where(rest > step, shifted, np.uint64(0))
    return (key << np.uint64(3)) | np.minimum(rest, width).astype(np.uint64)


def suffix_order(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Suffixes of one shard in order, by doubling; key: seven bytes each. Equal suffixes stay in text order."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    depth, longest = 7, int(rest.max(initial=0))

    def ranked(values: np.ndarray) -> np.ndarray:
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], values[order][1:] != values[order][:-1]]))
        return rank

    rank = ranked(key)
    while depth < longest and int(rank[order[-1]]) < n - 1:
        later = np.zeros(n, np.uint64)
        later[: n - depth] = rank[depth:] + np.uint64(1)
        pair = (rank << np.uint64(32)) | np.where(rest >= depth, later, np.uint64(0))
        order = np.argsort(pair)
        rank = ranked(pair)
        depth *= 2
    return np.argsort((rank << np.uint64(32)) | np.arange(n, dtype=np.uint64))


def merged_blocks(transforms: list[np.ndarray], window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: shard element at each merged place, and its block of equal `window`-byte prefixes."""
    transform = np.concatenate(transforms)
    n = len(transform)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(x) for x in transforms])
    block = np.zeros(n, np.int32)
    bits = np.uint64(max(n - 1, 1).bit_length())
    fits = int(bits) + 8 * step + 3 <= 64
    index = np.arange(n, dtype=np.uint64)
    element = np.arange(n)
    for _ in range(window // step):
        symbol = transform[element]
        if fits:
            turn = (np.sort((symbol << bits) | index) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        else:
            turn = np.argsort(symbol, kind="stable")
        symbol, before = symbol[turn], block[turn]
        new = (symbol & np.uint64(7)) < step
        new[0] = True
        new[1:] |= (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        block = np.cumsum(new, dtype=np.int32)
        shard = shard[turn]
        element = np.empty(n, np.int64)
        element[np.argsort(shard, kind="stable")] = np.arange(n)
        if block[-1] == n:
            break
    return element, block


def later_windows(bucket: sk.Bucket, window: int, gram: int) -> sk.Spans:
    """Byte spans of the windows of a bucket that occurred earlier."""
    some = np.flatnonzero(repeated(stretch_hashes(bucket, bucket.start + bucket.seed, gram)))
    # Equal strings: the earliest stays, and only it is looked into.
    order = some[np.lexsort((bucket.place[some], bucket.print[some], bucket.id[some]))]
    known: dict[bytes, int] = {}
    gone, left = [], []
    raw = bucket.data.tobytes()
    for i, a, n in zip(order.tolist(), bucket.start[order].tolist(), bucket.size[order].tolist()):
        first = known.setdefault(raw[a : a + n], i)
        if first == i:
            left.append(i)
        elif (bucket.id[i], bucket.print[i], bucket.place[i]) != (bucket.id[first], bucket.print[first], bucket.place[first]):
            gone.append(i)
    del raw, known
    whole = np.array(gone, np.int64)
    found = [(bucket.id[whole], bucket.print[whole], bucket.place[whole], bucket.place[whole] + bucket.size[whole])]
    kept = candidates(bucket, np.array(left, np.int64), window, gram)
    if len(kept) > 1:
        found.append(interval_spans(bucket, kept, window))
    return tuple(np.concatenate(x) for x in zip(*found))


def interval_spans(bucket: sk.Bucket, strings: np.ndarray, window: int) -> sk.Spans:
    step = next(k for k in (5, 4, 3, 2, 1) if window % k == 0)
    size = bucket.size[strings] + 1  # with an end mark
    start = np.cumsum(size) - size
    data = v.gather(bucket.data, bucket.start[strings], size - 1)
    data = np.insert(data, np.cumsum(size - 1), 0)
    string = np.repeat(np.arange(len(strings)), size)
    offset = np.arange(len(data)) - start[string]
    rest = size[string] - 1 - offset
    seven, key = groups(data, rest, 7), groups(data, rest, step)
    # The symbol before each suffix. Before a string's first bytes stand its own last, short groups.
    before = np.arange(len(data)) - step
    early = offset < step
    before[early] = (start + size)[string[early]] - step + offset[early]
    symbol = key[before]
    shards, orders, transforms = min(SHARDS, len(strings)), [], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(1, shards) * len(data) / shards)
    edges = np.concatenate([[0], np.append(start, len(data))[np.unique(cuts)], [len(data)]])
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if z > a:
            orders.append(a + suffix_order(seven[a:z], rest[a:z]))
            transforms.append(symbol[orders[-1]])
    element, block = merged_blocks(transforms, window, step)
    position = np.concatenate(orders)[element]
    many = np.bincount(block)[block] > 1
    position, block = position[many], block[many]
    own = strings[string[position]]
    id_, print_, place = bucket.id[own], bucket.print[own], bucket.place[own] + offset[position]
    order = np.lexsort((place, print_, id_, block))
    begin, length = v.runs(np.diff(block[order], prepend=-1) != 0)
    first = order[np.repeat(begin, length)]
    order_first = np.empty(len(order), np.int64)
    order_first[order] = first
    later = (id_ != id_[order_first]) | (print_ != print_[order_first]) | (place != place[order_first])
    # Windows to remove, in the order of their strings, as runs.
    flags = np.zeros(len(data), bool)
    flags[position[later]] = True
    a, z = v.spans_of(flags)  # an end mark lies between strings, and is never flagged
    own = strings[string[a]]
    return bucket.id[own], bucket.print[own], bucket.place[own] + offset[a], bucket.place[own] + offset[z - 1] + window


def remove_later_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row of docs as `row`, with doc_id, n_bytes, n_removed, n_spans, the removed `spans` and `kept` bytes."""
    prepare(docs.sparkSession)
    plan, texts = scheme(window), sk.keyed(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in v.pieces(batch):
                data, offsets = v.utf8(part.column("text"))
                gone = sk.covered(part, offsets)
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                begin[inner] = gone[inner]
                end = gone.copy()
                end[:-1] &= ~gone[1:]
                final = offsets[1:][np.diff(offsets) > 0] - 1
                end[final] = gone[final]
                removed, spans_before = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begin))
                a, z = np.flatnonzero(begin), np.flatnonzero(end) + 1
                base = np.repeat(offsets[:-1], np.diff(spans_before))
                runs = pa.ListArray.from_arrays(pa.array(spans_before, pa.int32()), pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(z - base, pa.int64())], ["begin", "end"]))
                kept = data[~gone]
                at = offsets - removed
                texts = [kept[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.record_batch([part.column("_row"), *(pa.array(np.diff(x), pa.int64()) for x in (offsets, removed, spans_before)), runs, pa.array(texts, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = sk.with_spans(docs, sk.settled(sk.repeated_spans(sk.pack(texts, plan, sk.frequent_grams(texts, plan)), lambda bucket: later_windows(bucket, window, plan.gram))))
    out = T.StructType([T.StructField("row", joined.schema["_row"].dataType), *(T.StructField(name, T.LongType()) for name in ("n_bytes", "n_removed", "n_spans")), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(keep, out).select("row", F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept")
