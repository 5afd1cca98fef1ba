"""Operator 6: documents linked by the Jaccard similarity of their word shingles.

Texts with equal shingle sets form a class, and classes are compared. One-permutation
hashing gives each class BINS minima from one pass; empty bins are filled by optimal
densification (each looks up bins in an order of its own until one is full). ROWS minima
make a band key; classes with a band key in common stand in one bucket. Two sets with a
similarity of 0.8 miss each other in all BANDS bands with probability (1 - 0.8**6)**42,
about 3 in a million.

A bucket gives candidate edges in the shape of a star: its least class with every other
one. They are confirmed on the full sets. What a star leaves open is closed exactly: in
buckets that still hold several components, sets are compared with each other, block by
block, inside tasks, and what comes out is a link for each set at most. No pair list of a
bucket is ever made.

Copies are collapsed before bands are made and stars are sums over a bucket, so a hot
text or bucket costs a row each; joins with a hot class are left to adaptive execution.

Defined cases: A-Z are lower-cased; a text with fewer words than a shingle has its whole
word sequence as its only one; null text and text without words have an empty set and are
linked with nothing; repeated rows and rows with one doc_id get the answer of their text;
a null doc_id never names a component unless all its documents have none.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm import vectors as v
from stopwise.llm.cluster import prepare, stored
from stopwise.llm.components import components
from stopwise.session import shuffle_partitions

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
TRIES = 256
BLOCK = 1024  # sets of a bucket; two such blocks are compared with each other at once
PERCENT = 80

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and where each text's begin (with the total)."""
    words = v.words(LOWER[data], offsets)
    hashes = v.Rolling(words.hashes())
    count = np.diff(words.first)
    windows = hashes.windows(size)
    inside = words.doc[: len(windows)] == words.doc[size - 1 :][: len(windows)]
    short = np.flatnonzero((count > 0) & (count < size))
    whole = hashes.slices(words.first[short], words.first[short + 1])
    value = np.concatenate([windows[inside], whole])
    doc = np.concatenate([words.doc[: len(windows)][inside], short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation hashing: the least value in each bin, with empty bins filled by optimal densification."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    mixed = v.mix(value)
    bin_ = ((mixed >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    table = np.full(n * BINS, EMPTY)
    np.minimum.at(table, doc * BINS + bin_.astype(np.int64), v.mix(mixed + v.BASE))
    table = table.reshape(n, BINS)
    filled = table != EMPTY
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = table.copy()
    for attempt in range(1, TRIES + 1):
        if not len(row):
            break
        # The same bin looks in the same places in every text.
        source = (v.mix(column.astype(np.uint64) * np.uint64(TRIES + 1) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        hit = filled[row, source]
        out[row[hit], column[hit]] = table[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
    step = 1
    while len(row):  # hardly any bin is full: go round
        source = (column + step) % BINS
        hit = filled[row, source]
        out[row[hit], column[hit]] = table[row[hit], source[hit]]
        row, column, step = row[~hit], column[~hit], step + 1
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = v.mix(key * v.BASE + parts[:, :, i])
    return key


def sets_of_documents(docs: DataFrame, size: int) -> DataFrame:
    """_id, _print, n, set_key (a digest of the set; null if it is empty) and band keys of each row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in v.pieces(batch):
                value, first = shingles(*v.utf8(part.column("text")), size)
                n = np.diff(first)
                raw = value.tobytes()
                keys = [hashlib.md5(raw[8 * a : 8 * z]).digest() if z > a else None for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
                bands = band_keys(signatures(value, first)).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                yield pa.record_batch([part.column("doc_id"), part.column("_print"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), bands], ["doc_id", "_print", "n", "set_key", "bands"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("_print"), "text")
    return rows.mapInArrow(describe, "doc_id long, _print long, n long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_key, n, set): 48 bits of each shingle hash, in order, of one document of each wanted class."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in v.pieces(batch):
                value, first = shingles(*v.utf8(part.column("text")), size)
                short = (value >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                sets = [short[6 * a : 6 * z] for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch([part.column("set_key"), pa.array(np.diff(first), pa.int64()), pa.array(sets, pa.binary())], ["set_key", "n", "set"])

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.xxhash64("doc_id", "text").alias("_print"), "text")
    # Repeated rows would give a set twice.
    return rows.join(wanted, ["_id", "_print"]).select("set_key", "text").mapInArrow(describe, "set_key binary, n long, set binary").dropDuplicates(["set_key"])


def elements(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of some sets one after another, and the set of each."""
    raw = np.frombuffer(b"".join(sets), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64).ravel(), np.repeat(np.arange(len(sets)), [len(x) // 6 for x in sets])


def similar(common: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (one + other - common)


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those edges (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, own = elements(batch.column("set_a").to_pylist())
            other, its = elements(batch.column("set_b").to_pylist())
            # Elements of both sides under one number for each pair of sets; equal neighbours are common.
            value = np.concatenate([one, other])
            pair = np.concatenate([own, its])
            order = np.lexsort((value, pair))
            value, pair = value[order], pair[order]
            equal = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
            common = np.bincount(pair[1:][equal], minlength=batch.num_rows)
            sizes = [np.bincount(x, minlength=batch.num_rows) for x in (own, its)]
            good = pa.array(similar(common, *sizes, percent))
            yield pa.record_batch([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    left = sets.select(F.col("set_key").alias("b"), F.col("set").alias("set_b"))
    right = sets.select(F.col("set_key").alias("a"), F.col("set").alias("set_a"))
    return edges.join(left, "b").join(right, "a").mapInArrow(check, "a binary, b binary")


def compared_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is similar in a bucket; members: (bucket, set_key, spread), spread being the number of blocks.

    Every pair of blocks is a group of its own, so a bucket of any size is compared whole
    by groups of a fixed size.
    """
    block = F.pmod(F.xxhash64("set_key"), F.col("spread")).cast("int")
    placed = members.withColumn("_block", block)
    # Block i meets block j in group (i, j), i <= j.
    pairs = F.transform(F.sequence(F.lit(0), F.col("spread") - 1), lambda j: F.struct(F.least("_block", j).alias("i"), F.greatest("_block", j).alias("j")))
    groups = placed.select("bucket", "set_key", F.explode(pairs).alias("_pair")).select("set_key", F.xxhash64("bucket", "_pair.i", "_pair.j").alias("_group"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: list[bytes], held: list[bytes]) -> pa.RecordBatch:
            value, row = elements(held)
            _, column, times = np.unique(value, return_inverse=True, return_counts=True)
            # What stands in one set only is common to none.
            number = np.cumsum(times > 1) - 1
            several = times[column] > 1
            row, column = row[several], number[column[several]]
            common = np.zeros((len(held), len(held)), np.float32)
            for begin in range(0, int(number.max(initial=-1)) + 1, 2048):
                part = (column >= begin) & (column < begin + 2048)
                matrix = np.zeros((len(held), 2048), np.float32)
                matrix[row[part], column[part] - begin] = 1
                common += matrix @ matrix.T
            size = np.array([len(x) // 6 for x in held])
            near = similar(common.astype(np.int64), size[:, None], size[None, :], percent)
            np.fill_diagonal(near, True)
            # A link from each set to the first one that it reaches, the least, says the same as all links.
            label = np.arange(len(held))
            while True:
                least = np.where(near, label[None, :], len(held)).min(axis=1)
                least = least[least]
                if np.array_equal(least, label):
                    break
                label = least
            b = np.flatnonzero(label != np.arange(len(held)))
            return pa.record_batch([pa.array([keys[i] for i in label[b].tolist()], pa.binary()), pa.array([keys[i] for i in b.tolist()], pa.binary())], ["a", "b"])

        now, keys, held = None, [], []
        for batch in batches:
            for group, key, one in zip(*(batch.column(c).to_pylist() for c in ("_group", "set_key", "set"))):
                if group != now and len(keys) > 1:
                    yield links(keys, held)
                if group != now:
                    now, keys, held = group, [], []
                keys.append(key)
                held.append(one)
        if len(keys) > 1:
            yield links(keys, held)

    rows = groups.join(sets.select("set_key", "set"), "set_key")
    return rows.repartition("_group").sortWithinPartitions("_group", "set_key").mapInArrow(compare, "a binary, b binary").distinct()


def released(df: DataFrame, name: str) -> DataFrame:
    """The rows in shared storage; the shuffles behind them may go."""
    kept = stored(df, name)
    del df
    gc.collect()
    kept.sparkSession.sparkContext._jvm.System.gc()
    return kept


def own_name() -> Column:
    """What a row is chosen by: the least one has the smallest doc_id, or none if no row of its group has one."""
    return F.struct(F.isnull("doc_id").alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "_print")


def crowded(classes: DataFrame) -> DataFrame:
    """Sets of so many copies that one would fill half a partition, with the pieces to cut them into; at most twice as many as there are partitions."""
    partitions = shuffle_partitions(classes.sparkSession)
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    many = classes.filter(F.col("copies") * 2 * partitions > total)
    return many.select("set_key", F.ceil(F.col("copies") * 4 * partitions / max(total, 1)).cast("int").alias("_pieces"))


def by_class(rows: DataFrame, final: DataFrame, many: DataFrame) -> DataFrame:
    """Each row with what is known of its set. The copies of a crowded set go to several tasks by their hash."""
    piece = F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64("doc_id", "_print"), F.col("_pieces"))).otherwise(0).cast("int")
    left = rows.join(F.broadcast(many), "set_key", "left").select(*rows.columns, F.struct("set_key", piece.alias("piece")).alias("_part"))
    pieces = F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)).alias("piece")
    right = final.join(F.broadcast(many), "set_key", "left").select(*final.columns, pieces).select(F.struct("set_key", "piece").alias("_part"), *[c for c in final.columns if c != "set_key"])
    return left.join(right, "_part", "left").drop("_part")


def near_copies(docs: DataFrame, size: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, _print, n_shingles, component_id and kept of every row."""
    return grouped(docs, size, percent).drop("stays")


def grouped(docs: DataFrame, size: int = 2, percent: int = PERCENT) -> DataFrame:
    """near_copies with `stays`: true for one (doc_id, _print) of each component, whatever its doc_ids are, and for empty sets."""
    prepare(docs.sparkSession)
    rows = stored(sets_of_documents(docs, size), "sets")
    classes = rows.filter("n > 0").groupBy("set_key").agg(F.first("n").alias("n"), F.min("doc_id").alias("_first"), F.min(own_name()).alias("_from"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = released(classes, "classes")
    banded = classes.select("set_key", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("set_key").alias("center")).filter("size > 1")
    members = released(banded.join(shared, "bucket"), "buckets")
    center = classes.select(F.col("set_key").alias("center"), F.col("n").alias("_center_n"))
    stars = members.filter("set_key != center").select("center", "set_key", "n").distinct().join(center, "center")
    edges = stars.filter(100 * F.least("n", "_center_n") >= percent * F.greatest("n", "_center_n")).select(F.col("center").alias("a"), F.col("set_key").alias("b"))
    edges = released(edges, "edges")
    wanted = members.filter("size > 2").select("set_key").union(edges.select("a")).union(edges.select("b")).distinct()
    sets = released(full_sets(docs, wanted.join(classes, "set_key").select("set_key", "_from._id", "_from._print"), size), "full")
    links = stored(confirmed(edges, sets, percent), "links")
    labels = components(links)
    # Buckets of more than two classes that are not in one component hold pairs that no star has tried.
    placed = members.filter("size > 2").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).filter("_least != _most").select("bucket")
    rest = placed.join(open_, "bucket").select("bucket", "set_key", F.ceil(F.col("size") / BLOCK).cast("int").alias("spread"))
    links = links.union(compared_in_blocks(rest, sets, percent))
    labels = components(links)
    linked = labels.join(classes.select(F.col("set_key").alias("node"), "_first", "_from"), "node")
    named = linked.join(linked.groupBy("component").agg(F.min("_first").alias("component_id"), F.min("_from").alias("_least")), "component").select(F.col("node").alias("set_key"), "component_id", "_least")
    final = classes.select("set_key", "_first", "_from").join(named, "set_key", "left").select("set_key", F.coalesce("component_id", "_first").alias("component_id"), F.coalesce("_least", "_from").alias("_least"))
    out = by_class(rows.select("doc_id", "_print", "n", "set_key"), final, crowded(classes))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_print", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), ((F.col("n") == 0) | (own_name() == F.col("_least"))).alias("stays"))
