"""Operator 5: pack token sequences into windows by minimum bin slack.

Texts are tokenised where they are read. Whole windows of a document become sequences of
their own; what remains waits in a pool of bounded size. A window is opened with the
longest remainder; a bitset of reachable sums over the multiset of remaining lengths then
picks those that fill it closest to its capacity, and the counts are found by walking the
bitsets backwards. If slack is left, one more remainder is cut to fill it. A pool that
runs dry at the end of a task is laid out in sequences whose lengths are powers of two,
which need no padding. So no sequence is padded, and nothing is shuffled or collected.

The tokenizer's merges are read from a rank file of the same vocabulary, which is several
times faster and gives the same ids (tested); texts it cannot take go to the tokenizer
itself. Sequence ids count from the task's partition number times 2**40.

Defined cases: null text is the empty text, whose only token is the end mark; repeated
rows are packed once each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stopwise.llm.cluster import prepare

CAPACITY = 1024
POOL = 2048  # remainders a task holds before it packs them
END = 0  # id after each document
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
LONG_BLANK = re.compile(r"\s{2000}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of a text as an array."""

    def __init__(self, name: str):
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        self.path = public_tokenizers.path(f"{name}.json")
        self.exact = None

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= 2000 and LONG_BLANK.search(text):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if SPECIAL in text:
            return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        return np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)


def encoder(name: str = TOKENIZER) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def fill(capacity: int, counts: list[int]) -> list[tuple[int, int]]:
    """Which lengths, and how many of each, sum up closest to capacity; counts[n]: pieces of length n."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> capacity:
            break
    rest, picked = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            rest -= length * take
            picked.append((length, take))
    return picked


class Packer:
    """Pieces of documents laid into sequences."""

    def __init__(self, capacity: int, sequence: int):
        self.capacity, self.sequence = capacity, sequence
        self.counts = [0] * capacity
        self.waiting: list[list[tuple]] = [[] for _ in range(capacity)]
        self.held = 0
        self.out: list[tuple] = []

    def place(self, piece: tuple, length: int, offset: int) -> None:
        doc_id, start, ids, total = piece
        self.out.append((doc_id, start, length, zlib.crc32(ids[:length].tobytes()), total, self.sequence, offset))

    def wait(self, piece: tuple) -> None:
        self.counts[len(piece[2])] += 1
        self.waiting[len(piece[2])].append(piece)
        self.held += 1

    def take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.held -= 1
        return self.waiting[length].pop()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= self.capacity:
            self.place((doc_id, at, ids[at:], len(ids)), self.capacity, 0)
            self.sequence += 1
            at += self.capacity
        if at < len(ids):
            self.wait((doc_id, at, ids[at:], len(ids)))

    def longest(self, most: int) -> int:
        return next((n for n in range(min(most, self.capacity - 1), 0, -1) if self.counts[n]), 0)

    def window(self, size: int) -> None:
        """One sequence of `size` tokens, which the pool has."""
        free = size

        def lay(length: int, use: int) -> None:
            nonlocal free
            piece = self.take(length)
            self.place(piece, use, size - free)
            free -= use
            if use < length:
                doc_id, start, ids, total = piece
                self.wait((doc_id, start + use, ids[use:], total))

        first = self.longest(size)
        if first:
            lay(first, first)
        for length, many in fill(free, self.counts):
            for _ in range(many):
                lay(length, length)
        while free:  # slack: cut what is just long enough, or else the longest
            length = next((n for n in range(free, self.capacity) if self.counts[n]), 0) or self.longest(free)
            lay(length, min(length, free))
        self.sequence += 1

    def pack(self, least: int) -> None:
        while self.held > least:
            tokens = sum(n * c for n, c in enumerate(self.counts) if c) if self.held < 4 * self.capacity and least == 0 else self.capacity
            size = self.capacity if tokens >= self.capacity else 1 << (tokens.bit_length() - 1)
            self.window(size)


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each piece; see SCHEMA. Pieces of a sequence follow each other without gap."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    prepare(docs.sparkSession)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(capacity, TaskContext.get().partitionId() << 40), encoder(tokenizer)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [[]] * 7
            packer.out = []
            return pa.record_batch([pa.array(column, pa.int64()) for column in columns], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc_id, np.append(encode.ids(text.as_py() or ""), np.uint32(END)))
                if packer.held > 2 * POOL:
                    packer.pack(POOL)
                if len(packer.out) > 1 << 14:
                    yield rows()
        packer.pack(0)
        yield rows()

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lay_out, SCHEMA)
