"""Super-k-mer partitioning: consecutive windows with one minimiser travel as one string.

A window is a fixed number of tokens (words or bytes) of one text. Its minimiser is the
smallest hash among the shorter grams inside it, so equal windows have equal minimisers
and meet in one bucket. Neighbouring windows mostly share theirs: such a run is sent as
one packed string with its place, not as many windows.

Spread. Identical strings of a batch are sent once, and what that decides is noted on the
spot; thousands of copies of a text thus cost one string a batch. Grams that fill more
than their share of the corpus are ranked last as minimisers (`frequent_grams`), so runs
that only touch a common passage go to buckets chosen by their other words. The list
steers the work; any list gives the same windows.

Recovery. Every step is a plain function of its input rows: a lost task is run again.
"""

from __future__ import annotations

import gc
import struct
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import vectors as v
from stopwise.llm.cluster import stored
from stopwise.session import shuffle_partitions

FLUSH_BYTES = 16 << 20  # packed text that a task gathers before it sends it off
LONGEST_RUN = 256  # windows a string holds at most; longer runs are cut
HOT_BOUND = 1 << 16  # grams in the list of frequent ones
LAST = np.uint64(1 << 63)


@dataclass
class Tokens:
    """Tokens of a batch of texts."""

    data: np.ndarray
    start: np.ndarray  # first byte of each token
    length: np.ndarray
    doc: np.ndarray  # row of the text
    place: np.ndarray  # number of the token within its text
    grams: np.ndarray  # hash of the gram that starts at each token


@dataclass(frozen=True)
class Scheme:
    """How texts are cut and matched."""

    tokens: Callable[[np.ndarray, np.ndarray, int], Tokens]
    window: int
    gram: int
    keep_first: bool  # the earliest of equal windows does not count as repeated
    rare: int  # one of so many grams is small enough to be a likely minimiser


def keyed(docs: DataFrame) -> DataFrame:
    """`_id` and `_print` name a text; repeated rows share them."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.xxhash64("doc_id", "text").alias("_print"), "text")


def bucket_count(spark: SparkSession) -> int:
    return 8 * shuffle_partitions(spark)


def frequent_grams(docs: DataFrame, scheme: Scheme) -> np.ndarray:
    """Grams with more than a sixteenth of a bucket's share of all tokens, sorted; at most HOT_BOUND.

    A gram with a share of all tokens has it in some batch, so a count by batch that
    forgets the rare ones loses no frequent gram. Only its count may come out low.
    """
    buckets = bucket_count(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in v.pieces(batch):
                tokens = scheme.tokens(*v.utf8(part.column("text")), scheme.gram)
                small = tokens.grams[tokens.grams < np.uint64((1 << 64) // scheme.rare)]
                gram, n = np.unique(small, return_counts=True)
                often = (n >= 8) & (n * 65536 >= len(tokens.doc))
                yield pa.record_batch([pa.array([None, *gram[often].view(np.int64)], pa.int64()), pa.array([len(tokens.doc), *n[often]], pa.int64())], ["gram", "n"])

    counts = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.col("gram").isNotNull(), F.desc("n")).limit(HOT_BOUND).collect()
    total = rows[0].n if rows else 0
    hot = [row.gram for row in rows[1:] if row.n * 16 * buckets >= total]
    return np.sort(np.array(hot, np.int64).view(np.uint64))


def cut_runs(tokens: Tokens, scheme: Scheme, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run; the rank of every gram."""
    rank = tokens.grams >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens.grams), len(hot) - 1)
        rank = np.where(hot[at] == tokens.grams, rank | LAST, rank)
    count = len(tokens.doc) - scheme.window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), rank
    least = v.sliding_min(rank, scheme.window - scheme.gram + 1)[:count]
    valid = tokens.doc[:count] == tokens.doc[scheme.window - 1 :]
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]))
    begin = np.flatnonzero(first)
    inside = np.flatnonzero(valid)
    length = np.diff(np.append(np.searchsorted(inside, begin), len(inside)))
    parts = -(-length // LONGEST_RUN)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(begin, parts) + nth * LONGEST_RUN
    length = np.minimum(np.repeat(length, parts) - nth * LONGEST_RUN, LONGEST_RUN)
    return begin, length, least[begin], rank


def single_seeds(rank: np.ndarray, begin: np.ndarray, length: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs cut so that all windows of one hold the same first copy of its minimiser, and where that begins.

    Equal windows are then in different runs, also within periodic text.
    """
    done: list[tuple[np.ndarray, ...]] = []
    while len(begin):
        seed = seed_offsets(rank, begin, least, width)
        now = np.minimum(length, seed + 1)
        done.append((begin, now, least, seed))
        more = length > now
        begin, length, least = (begin + now)[more], (length - now)[more], least[more]
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (begin, length, least, begin)


def seed_offsets(rank: np.ndarray, begin: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """How many tokens after the start of each run its minimiser begins."""
    offset = np.zeros(len(begin), np.int64)
    open_ = np.arange(len(begin))
    for step in range(width):
        hit = rank[begin[open_] + step] == least[open_]
        offset[open_[hit]] = step
        open_ = open_[~hit]
    return offset


def squeeze(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def pack(docs: DataFrame, scheme: Scheme, hot: np.ndarray) -> DataFrame:
    """Rows (bucket, kind, blob): packed strings (kind 1), or token spans already decided (kind 0)."""
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    shared = spark.sparkContext.broadcast(hot)

    def flush(table: dict, local: list) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bytes]] = []
        if table:
            fields = np.array(list(table.values()), np.int64)  # bucket, id, print, place, windows, repeated, seed
            strings = list(table)
            order = np.argsort(fields[:, 0], kind="stable")
            begin, size = v.runs(np.diff(fields[order, 0], prepend=-1) != 0)
            for b, n in zip(begin.tolist(), size.tolist()):
                rows = order[b : b + n]
                own = [strings[i] for i in rows.tolist()]
                some = fields[rows]
                lengths = np.fromiter(map(len, own), np.int32, n)
                out.append((int(some[0, 0]), 1, squeeze(struct.pack("<q", n), some[:, 1].tobytes(), some[:, 2].tobytes(), some[:, 3].tobytes(), some[:, 4].astype(np.int16).tobytes(), some[:, 5].astype(np.int8).tobytes(), some[:, 6].astype(np.int16).tobytes(), lengths.tobytes(), *own)))
        if local:
            spans = np.array(local, np.int64)
            out.append((int(spans[0, 1] % buckets), 0, squeeze(np.ascontiguousarray(spans.T).tobytes())))
        for i in range(0, len(out), 256):
            part = out[i : i + 256]
            yield pa.record_batch([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.binary())], ["bucket", "kind", "blob"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple] = {}
        local: list[tuple] = []
        held = 0
        for batch in batches:
            for part in v.pieces(batch, most=1 << 19):
                tokens = scheme.tokens(*v.utf8(part.column("text")), scheme.gram)
                begin, length, least, rank = cut_runs(tokens, scheme, shared.value)
                seed = np.zeros(len(begin), np.int64)
                if scheme.keep_first:
                    begin, length, least, seed = single_seeds(rank, begin, length, least, scheme.window - scheme.gram + 1)
                last = begin + length + scheme.window - 2
                left, right = tokens.start[begin], tokens.start[last] + tokens.length[last]
                bucket = v.mix(least) % np.uint64(buckets)
                doc = tokens.doc[begin]
                ids, prints = (np.asarray(part.column(name))[doc] for name in ("_id", "_print"))
                raw = tokens.data.tobytes()
                for a, z, *row in zip(left.tolist(), right.tolist(), bucket.tolist(), ids.tolist(), prints.tolist(), tokens.place[begin].tolist(), length.tolist(), seed.tolist()):
                    text = raw[a:z]
                    b, i, p, at, n, s = row
                    known = table.get(text)
                    if known is None:
                        table[text] = (b, i, p, at, n, 0, s)
                        held += z - a
                        continue
                    if scheme.keep_first:
                        if (i, p, at) < known[1:4]:
                            table[text], (i, p, at) = (b, i, p, at, n, 0, s), known[1:4]
                        elif (i, p, at) == known[1:4]:
                            continue
                    elif not known[5]:
                        table[text] = (*known[:5], 1, s)
                        local.append((*known[1:4], known[3] + n + scheme.window - 1))
                    local.append((i, p, at, at + n + scheme.window - 1))
                if held >= FLUSH_BYTES or len(local) >= 1 << 18:
                    yield from flush(table, local)
                    table, local, held = {}, [], 0
        yield from flush(table, local)

    return docs.mapInArrow(send, "bucket int, kind int, blob binary")


@dataclass
class Bucket:
    """Strings that met in a bucket. `data` holds them one after another."""

    data: np.ndarray
    start: np.ndarray  # first byte of each string
    size: np.ndarray  # its bytes
    id: np.ndarray
    print: np.ndarray
    place: np.ndarray
    windows: np.ndarray
    repeated: np.ndarray
    seed: np.ndarray


def unpack(blobs: list[bytes]) -> Bucket:
    columns: list[list[np.ndarray]] = [[] for _ in range(8)]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = struct.unpack_from("<q", raw)[0], 8
        for column, kind in zip(columns, (np.int64, np.int64, np.int64, np.int16, np.int8, np.int16, np.int32)):
            column.append(np.frombuffer(raw, kind, n, at))
            at += column[-1].nbytes
        columns[7].append(np.frombuffer(raw, np.uint8, offset=at))
    ids, prints, place, windows, repeated, seed, size, data = (np.concatenate(x) for x in columns)
    size = size.astype(np.int64)
    return Bucket(data, np.cumsum(size) - size, size, ids, prints, place, windows.astype(np.int64), repeated, seed.astype(np.int64))


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def repeated_spans(packed: DataFrame, resolve: Callable[[Bucket], Spans]) -> DataFrame:
    """Rows (_id, _print, begin, end): token spans to remove, found bucket by bucket."""

    def rows(spans: Spans) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in spans], ["_id", "_print", "begin", "end"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        now = None
        for batch in batches:
            for bucket, kind, blob in zip(*(column.to_pylist() for column in batch.columns)):
                if not kind:
                    yield rows(tuple(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(4, -1)))
                    continue
                if bucket != now and blobs:
                    yield rows(resolve(unpack(blobs)))
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield rows(resolve(unpack(blobs)))

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "_id long, _print long, begin long, end long")


def covered(part: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    """Which tokens the spans of a batch of texts cover; first: number of each text's first token, and the total."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    spans = part.column("_spans")
    if spans.null_count < len(spans):
        doc = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0)))
        flat = spans.flatten()
        np.add.at(edge, first[doc] + np.asarray(flat.field("begin")), 1)
        np.add.at(edge, first[doc] + np.asarray(flat.field("end")), -1)
    return np.cumsum(edge[:-1]) > 0


def settled(spans: DataFrame) -> DataFrame:
    """The spans, written to shared storage. What their shuffle left on disk is then free to go."""
    spark, kept = spans.sparkSession, stored(spans, "spans")
    del spans
    gc.collect()
    for _ in range(3):  # Spark removes shuffle files once the driver has dropped their plans, which its listeners hold a little longer
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)
    return kept


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row of docs, packed as `_row`, with its text and its spans.

    Copies of a row find the same spans; a set, combined before the shuffle, holds each once, and so
    no more of them than the text has tokens.
    """
    by_text = spans.groupBy("_id", "_print").agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("_row"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.xxhash64("doc_id", "text").alias("_print"), "text")
    return rows.join(by_text, ["_id", "_print"], "left").select("_row", "text", "_spans")
