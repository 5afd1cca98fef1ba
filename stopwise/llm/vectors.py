"""Array code shared by the text operators: whole batches of texts as flat byte arrays.

All hashes are 64-bit polynomials modulo 2**64 followed by a mixing step. They choose
partitions and group candidates; where a result depends on equality, callers compare
the bytes afterwards or say why they need not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2**64."""
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _powers[name] = np.multiply.accumulate(table)
        if len(_powers[name]) > 1 << 24:  # one giant text must not stay in memory
            return _powers.pop(name)[:n]
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any slices of one sequence after a single pass over it."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.sums[1:])
        self.inverse = powers(n + 1, INVERSE)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Of every run of `width` values, by its start."""
        count = max(len(self.sums) - width, 0)
        return mix((self.sums[width:] - self.sums[:count]) * self.inverse[:count] + np.uint64(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours, by the first of them."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = np.minimum(values[: len(values) - (width - span)], values[width - span :])
    return values


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; every row is in one run."""
    _, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words of some texts. In `data` each is followed by one space."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray  # row of the text
    first: np.ndarray  # number of the first word of each text, and the total
    origin: np.ndarray  # first byte of each word in the texts as they were given

    def hashes(self, step: int = 1 << 19) -> np.ndarray:
        """Of each word, taken a stretch of the texts at a time."""
        out = np.empty(len(self.start), np.uint64)
        first = 0
        while first < len(out):
            last = max(int(np.searchsorted(self.start, self.start[first] + step)), first + 1)
            base, start = self.start[first], self.start[first:last]
            end = start + self.length[first:last]
            out[first:last] = Rolling(self.data[base : end[-1]]).slices(start - base, end - base)
            first = last
        return out

    def join(self, begin: int, end: int) -> bytes:
        """Words begin to end - 1 joined by one space."""
        return b"" if begin >= end else self.data[self.start[begin] : self.start[end - 1] + self.length[end - 1]].tobytes()


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Cut texts into maximal runs of bytes outside `space`."""
    data = np.insert(data, offsets[1:], 32)
    ends = offsets[1:] + np.arange(1, len(offsets))
    blank = space[data]
    after = np.empty(len(data), bool)  # the byte after a word
    if len(data):
        after[0] = False
        after[1:] = blank[1:] & ~blank[:-1]
    keep = ~blank | after
    stop = np.flatnonzero(after)
    packed = data[keep]
    packed[after[keep]] = 32
    end = np.flatnonzero(after[keep])
    start = np.concatenate([np.zeros(min(len(end), 1), np.int64), end[:-1] + 1])
    doc = np.searchsorted(ends, stop + 1, side="left")
    first = np.searchsorted(doc, np.arange(len(offsets)), side="left")
    return Words(packed, start, end - start, doc, first, stop - (end - start) - doc)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices one after another."""
    total = int(length.sum())
    index = np.ones(total, np.int64)
    filled = length > 0
    start, length = start[filled], length[filled]
    if not len(start):
        return data[:0]
    index[0] = start[0]
    places = np.cumsum(length)[:-1]
    index[places] = start[1:] - start[:-1] - length[:-1] + 1
    return data[np.cumsum(index)]


def same_slices(data: np.ndarray, one: np.ndarray, other: np.ndarray, length: np.ndarray, step: int = 1 << 22) -> bool:
    """Are all pairs of slices equal byte for byte?"""
    total = np.cumsum(length)
    first = 0
    while first < len(one):
        last = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + step, side="right")), first + 1)
        part = slice(first, last)
        if not np.array_equal(gather(data, one[part], length[part]), gather(data, other[part], length[part])):
            return False
        first = last
    return True


def runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the groups whose first elements are flagged."""
    begin = np.flatnonzero(start)
    return begin, np.diff(np.append(begin, len(start)))


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
