"""Operator 7: WARC archives, written in shards and read back.

Records are range-sorted by page_id into a fixed number of shards. The ranges are worked out from
counts of all page_ids, so that the same pages give the same shards and bytes however
they are dealt out. A task writes its shard as a row of gzip files, one member for each record, and starts the next file once the
compressed size is reached. A file is written under a temporary name and renamed to its
final one, which depends only on shard and number; the manifest, written last by Spark, names
the files that count. A lost task or a second attempt writes the same bytes to the same
names, and what was left half done is in no manifest.

Pages with equal payloads: that with the smallest page_id is a response, the others are
revisit records that refer to it. Who revisits whom is settled on digests alone; its rows
travel in the same sort as the pages and arrive just before them, so texts are shuffled
once and a payload shared by many pages is one row of a sum.

Headers and digests are made anew when writing, and checked against the payload when reading.

Defined cases: null html is an empty payload; a null url is written as `urn:page:<id>`;
white space and control characters of a url are percent-encoded; rows that repeat both
page_id and payload revisit the first of them; a null page_id counts as the largest, goes to a
shard by its payload, and is read back as null; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.cluster import prepare
from stopwise.session import shuffle_partitions

BINS = 1 << 12  # ranges counted at once
FINE = 4  # a range holds at most this part of a shard's share of pages, or one page_id
ROLL_BYTES = 64 << 20  # compressed size at which a file ends
DATE = "2000-01-01T00:00:00Z"  # the same input gives the same bytes
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page_id: int | None, payload: str, copy: int = 0) -> str:
    """A page_id and payload have one response; later rows with both are numbered."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{payload}:{copy}')}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    lines = "".join(f"{k}: {x}\r\n" for k, x in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, first: int | None, copy: int) -> bytes:
    kind = "revisit" if revisit else "response"
    head = HEAD.format(len(payload)).encode()
    block = head if revisit else head + payload
    name = digest(payload)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page_id, name, copy)), ("WARC-Date", DATE),
               ("WARC-Target-URI", UNSAFE.sub(lambda m: quote(m[0]), url) if url else f"urn:page:{page_id}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", first, name))]
        headers += [("Refers-To-Page-Id", str(first))] if first is not None else []
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{name}")]
    headers += [("Page-Id", str(page_id))] if page_id is not None else []
    headers += [("Url-Null", "1")] if url is None else []
    return member(headers, block)


class Shard:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.number, self.out = shard, roll, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temporary = f"{self.folder}/_attempts/{uuid.uuid4().hex}"
            self.store.create_dir(f"{self.folder}/_attempts")
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.hash = 0, 0, hashlib.sha256()
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", self.shard, "", self.number)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n"))
        self.put(data)
        self.records += 1
        if self.size >= self.roll:
            yield from self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.folder}/{self.name}")
            self.out, self.number = None, self.number + 1
            yield self.name, self.shard, self.records, self.size, self.hash.hexdigest()


def halved(value: Column, edges: list[int], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted edges are at or below a value, by halving."""
    high = len(edges) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value < edges[middle], halved(value, edges, low, middle)).otherwise(halved(value, edges, middle + 1, high))


def bounds(pages: DataFrame, shards: int) -> list[int]:
    """First page_id of each shard but the first: ranges of ids with about equal numbers of pages.

    Ids are counted by ranges of equal width. A range in which a shard should begin is counted
    again in finer ones, until it holds a small part of a shard or a single id. Each round is one
    aggregate; at most BINS counts, or a few for each shard, come to the driver.
    """
    ids = pages.select(F.col("page_id").cast("long").alias("id")).filter("id IS NOT NULL")
    ends = ids.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).first()
    if not ends.n or shards < 2:
        return []
    held: dict[int, tuple[int, int]] = {}  # by first id of a range: its last id and its pages
    open_ = [(ends.low, ends.high)]
    while open_:
        parts = max(FINE, BINS // len(open_))
        widths = [-(-(high - low + 1) // parts) for low, high in open_]
        lows, highs, widths_ = (F.array(*[F.lit(x).cast("decimal(20,0)") for x in column]) for column in ([x for x, _ in open_], [x for _, x in open_], widths))
        value, k = F.col("id").cast("decimal(20,0)"), F.col("k")
        placed = ids.select("id", (halved(F.col("id"), [low for low, _ in open_]) - 1).alias("k")).filter((k >= 0) & (value <= F.get(highs, k)))
        # Ids may be far apart, so differences are taken in decimals.
        nth = F.floor((value - F.get(lows, k)) / F.get(widths_, k)).cast("long").alias("nth")
        for row in placed.groupBy("k", nth).agg(F.count("*").alias("n")).collect():
            start = open_[row.k][0] + row.nth * widths[row.k]
            held[start] = min(open_[row.k][1], start + widths[row.k] - 1), row.n
        open_, seen = [], 0
        for start in sorted(held):
            last, n = held[start]
            begins = (seen + n) * shards // ends.n > seen * shards // ends.n  # a shard should begin within it
            seen += n
            if begins and n * FINE * shards > ends.n and last > start:
                open_.append((start, last))
        for start, _ in open_:
            del held[start]
    found, seen = [], 0
    for start in sorted(held):
        while len(found) + 1 < shards and seen * shards >= (len(found) + 1) * ends.n:
            found.append(start)
        seen += held[start][1]
    return found


def write(pages: DataFrame, folder: str, shards: int | None = None, roll: int = ROLL_BYTES) -> DataFrame:
    """Write all pages below folder (a URI that executors reach) and return the manifest."""
    spark = pages.sparkSession
    prepare(spark)
    shards = shards or shuffle_partitions(spark)
    edges = bounds(pages, shards)

    def placed(df: DataFrame, digest: Column, *more: Column) -> DataFrame:
        null = F.col("page_id").isNull()
        order = F.coalesce("page_id", F.lit((1 << 63) - 1)).cast("long")
        apart = F.when(null, F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int"))
        return df.select(F.coalesce(apart, halved(order, edges)).alias("_shard"), order.alias("_order"), null.alias("_null"), *more)

    html = F.coalesce("html", F.lit(""))
    small = pages.select("page_id", F.sha1(html).alias("_digest"), F.octet_length(html).alias("_bytes"))
    first = small.groupBy("_digest", "_bytes").agg(F.min("page_id").alias("_first"))
    later = small.distinct().join(first, ["_digest", "_bytes"]).filter(F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")))
    marks = placed(later, F.col("_digest"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "_digest", F.col("_first").cast("long").alias("_first"))
    rows = placed(pages, F.sha1(html), F.lit(1).alias("_kind"), "url", "html", F.lit(None).cast("string").alias("_digest"), F.lit(None).cast("long").alias("_first"))
    ordered = marks.unionByName(rows).repartitionById(shards, "_shard").sortWithinPartitions("_shard", "_order", "_null", "_kind", "url", "html")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        done: list[tuple] = []
        now, firsts, seen = None, {}, {}
        for batch in batches:
            for number, at, null, kind, url, html, mark, first in zip(*(column.to_pylist() for column in batch.columns)):
                if shard is None or shard.shard != number:
                    done += shard.close() if shard else []
                    shard, now = Shard(folder, number, roll), None
                if (at, null) != now:
                    now, firsts, seen = (at, null), {}, {}
                page_id = None if null else at
                if not kind:
                    firsts[mark] = first
                    continue
                payload = (html or "").encode()
                name = hashlib.sha1(payload).hexdigest()
                copy = seen[name] = seen.get(name, -1) + 1
                revisit, refers = (True, firsts[name]) if name in firsts else (copy > 0, page_id)
                done += shard.add(page_record(page_id, url, payload, revisit, refers, copy))
        done += shard.close() if shard else []
        yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*done)) or [[]] * 5, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "records", "bytes", "sha256"])

    ordered.mapInArrow(save, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked."""
    data, unpacker, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(step)
            if not data:
                if unpacker is not None:
                    raise ValueError("the archive ends inside a record")
                return
        unpacker = unpacker or zlib.decompressobj(31)
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = None, []


def parsed(record: bytes) -> tuple | None:
    """A row of RECORDS, or None for a record that holds no page."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}" or kind == "response" and (digest(payload) != said or len(payload) != size):
        raise ValueError(f"digest or length of {fields['WARC-Record-ID']} does not fit")
    number = lambda name: int(fields[name]) if name in fields else None
    url = None if "Url-Null" in fields else fields["WARC-Target-URI"]
    return number("Page-Id"), url, size, said, kind, number("Refers-To-Page-Id"), payload if kind == "response" else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """RECORDS of the archives that the manifest names; a task reads a file at a time, record by record."""
    prepare(spark)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names)

        for batch in batches:
            for name, count in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                rows, held, total = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in members(stream):
                        row = parsed(record)
                        if row is None:
                            continue
                        rows.append(row)
                        total, held = total + 1, held + len(record)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if total != count:
                    raise ValueError(f"{name} has {total} records, its manifest {count}")
                yield batch_of(rows)

    manifest = spark.read.parquet(f"{folder}/_manifest").select("file", "records")
    return manifest.repartition(shuffle_partitions(spark), "file").mapInArrow(load, RECORDS)
