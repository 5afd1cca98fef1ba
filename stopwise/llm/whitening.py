"""Operator 12: whiten embeddings along the leading eigenvectors of their covariance.

Entries become whole numbers first, x = floor(1024 c) + 100000. Two passes sum them up exactly:
the sums S, then the products of z = x - round(S/n), small whole numbers centred to within one half;
what the half leaves over is taken off in exact integers. So V does not depend on how rows are
dealt out, and is rounded once.

The spectrum of V is sliced: a factorisation LDL' of V - s, with pivots from the whole rest of the
matrix, has as many negative pivots as V has eigenvalues below s. Bisection with these counts isolates each
leading eigenvalue; Rayleigh quotient iteration from inside its interval converges cubically; two more counts,
just below and just above the result, certify its number. Eigenvalues closer together
than counts can tell apart are taken as one cluster, for which an orthonormal basis is found by inverse iteration
orthogonal to what is already there.

Defined cases: rows whose vector is null or has a null, NaN or infinite entry are left out; so are rows of
another length than most rows have (of several such lengths the longest) and empty vectors; null
and repeated vec_ids are rows like any other; components without variance are left out, so constant or too few rows
give fewer components or no rows; an empty table gives no rows. A deviation beyond a long is null. Entries of 2**40 or more raise
an OverflowError. The driver holds matrices of d x d numbers, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.cluster import prepare, stored

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**40
EPS = np.finfo(float).eps


def whole_numbers(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, lengths and (with a length) the x of valid vectors as a matrix of longs."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = sizes > 0
    good[owner[~np.isfinite(flat)]] = False
    if length is None:
        return np.flatnonzero(good), sizes[good], np.empty((0, 0), np.int64)
    good &= sizes == length
    values = flat[good[owner]].reshape(-1, length)
    if values.size and np.abs(values).max() >= LARGEST:
        raise OverflowError(f"entries of {LARGEST:.0f} or more cannot be whitened")
    return np.flatnonzero(good), sizes[good], np.floor(values * SCALE).astype(np.int64) + SHIFT


def pieces(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Whole numbers of the batch's valid vectors, 4096 rows at a time."""
    for start in range(0, batch.num_rows, 4096):
        yield whole_numbers(batch.column("embedding").slice(start, 4096), size)[2]


def exact_products(z: np.ndarray) -> np.ndarray:
    """z'z in whole numbers: by floating point in slices too small to round, else by Python's integers."""
    most = int(np.abs(z).max(initial=1)) ** 2
    rows = 2**53 // most
    if not rows:
        return z.astype(object).T @ z.astype(object)
    total = np.zeros((z.shape[1],) * 2, object)
    for start in range(0, len(z), rows):
        part = z[start : start + rows].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(rows: DataFrame, make, cells: str) -> DataFrame:
    """Decimal sums of what `make` yields for each batch as {cell: whole number}, combined in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for cell, value in make(batch):
                total[cell] = total[cell] + value if cell in total else value
        for cell, value in total.items():
            values = [int(v) for v in np.ravel(value)]
            yield pa.record_batch([pa.array([cell] * len(values), pa.int64()), pa.array(range(len(values)), pa.int64()), pa.array(values, pa.decimal128(38, 0))], [cells, "place", "value"])

    return rows.mapInArrow(work, f"{cells} long, place long, value decimal(38,0)").groupBy(cells, "place").agg(F.sum("value").alias("value"))


def fitted(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of x and n*n*V in whole numbers; n is 0 if no vector is valid."""
    lengths: DataFrame = _sums(rows, lambda b: ((int(size), np.array([n])) for size, n in zip(*np.unique(whole_numbers(b.column("embedding"))[1], return_counts=True))), "length")
    most = lengths.orderBy(F.desc("value"), F.desc("length")).head()
    if most is None:
        return 0, [], np.zeros((0, 0), object)
    n, size = int(most["value"]), most["length"]
    first = {r["place"]: int(r["value"]) for r in _sums(rows, lambda b: [(0, x.sum(axis=0).astype(object)) for x in pieces(b, size)], "cell").collect()}
    sums = [first[i] for i in range(size)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    second = {r["place"]: int(r["value"]) for r in _sums(rows, lambda b: [(0, exact_products(x - middle)) for x in pieces(b, size)], "cell").collect()}
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle)], object)
    matrix = n * np.array([second[i] for i in range(size * size)], object).reshape(size, size) - np.outer(rest, rest)
    return n, sums, matrix


def inertia(matrix: np.ndarray) -> int:
    """Negative pivots of LDL' with 1x1 and 2x2 pivots chosen from all that is left (Bunch and Parlett)."""
    a, negative = matrix.copy(), 0
    ratio = (1 + math.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        i = int(diagonal.argmax())
        p, q = divmod(int(np.abs(a).argmax()), len(a))
        if diagonal[i] >= ratio * abs(a[p, q]):
            if a[i, i] == 0:
                return negative  # only zeros are left
            negative += a[i, i] < 0
            column = np.delete(a[:, i], i)
            a = np.delete(np.delete(a, i, 0), i, 1) - np.outer(column, column) / a[i, i]
        else:
            block = a[np.ix_([p, q], [p, q])]
            negative += 1  # its determinant is negative
            columns = np.delete(a[:, [p, q]], [p, q], 0)
            a = np.delete(np.delete(a, [p, q], 0), [p, q], 1) - columns @ np.linalg.solve(block, columns.T)
    return negative


class Slicer:
    """Leading eigenpairs of a symmetric matrix without negative eigenvalues."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.size = matrix, len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max(initial=0))
        self.close = 4 * self.size * EPS * self.norm  # what counts cannot tell apart
        self.counts: dict[float, int] = {}

    def below(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.matrix - shift * np.eye(self.size))
        return self.counts[shift]

    def isolated(self, number: int) -> tuple[float, float]:
        """An interval that holds the eigenvalue of this number from the top, alone unless it is as narrow as can be."""
        low, high = -self.close, self.norm + self.close
        rank = self.size - number  # eigenvalues below it
        for shift, count in self.counts.items():
            low, high = (max(low, shift), high) if count <= rank else (low, min(high, shift))
        while high - low > 2 * self.close and not (self.below(low) == rank and self.below(high) == rank + 1):
            middle = (low + high) / 2
            low, high = (middle, high) if self.below(middle) <= rank else (low, middle)
        return low, high

    def solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0, 1, 2):
            try:
                y = np.linalg.solve(self.matrix - (shift + nudge * EPS * self.norm) * np.eye(self.size), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and y.any():
                return y / np.linalg.norm(y)
        return x

    def pair(self, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """Eigenvalue and unit vector of this number, orthogonal to those found before."""
        low, high = self.isolated(number)
        basis = np.array(found).reshape(-1, self.size)

        def orthogonal(x: np.ndarray) -> np.ndarray:
            for _ in range(2):
                x = x - basis.T @ (basis @ x)
            return x / np.linalg.norm(x)

        while True:
            x = orthogonal(np.random.default_rng(number).standard_normal(self.size))
            for _ in range(3):  # from the middle of the interval
                x = orthogonal(self.solve((low + high) / 2, x))
            value, best = float(x @ self.matrix @ x), math.inf
            for _ in range(12):
                gap = float(np.linalg.norm(self.matrix @ x - value * x))
                if gap >= best / 2 or not low <= value <= high:
                    break
                best = gap
                y = orthogonal(self.solve(value, x))
                x, value = y, float(y @ self.matrix @ y)
            if high - low <= 2 * self.close or low - self.close <= value <= high + self.close and self.certified(number, value):
                return value, x
            middle = (low + high) / 2
            low, high = (middle, high) if self.below(middle) <= self.size - number else (low, middle)

    def certified(self, number: int, value: float) -> bool:
        rank = self.size - number
        return self.below(value - self.close) <= rank < self.below(value + self.close)

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to `most` eigenvalues above rounding, falling, and their vectors as rows, each with its largest entry positive."""
        values, vectors = [], []
        for number in range(1, min(most, self.size) + 1):
            value, x = self.pair(number, vectors)
            if value <= self.close:
                break
            values.append(value)
            vectors.append(x * np.sign(x[np.abs(x).argmax()]))
        return np.array(values), np.array(vectors).reshape(-1, self.size)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each valid row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select(rows["vec_id"].cast("long"), rows["embedding"].cast("array<double>"))
    n, sums, products = fitted(rows)
    size = len(sums)
    trace = sum(products[i, i] for i in range(size))
    covariance = np.array([[v / (n * n) for v in row] for row in products.tolist()], float).reshape(size, size)
    values, vectors = Slicer(covariance).leading(components) if trace else (np.empty(0), np.empty((0, size)))
    total = trace / (n * n) if n else 1.0
    roots = np.sqrt(values)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle)], np.int64)  # at most n / 2

    def deviations(z: np.ndarray) -> list[int | None]:
        """Sums of (n z - rest) squared, exact."""
        if n * (float(np.abs(z).max(initial=0)) + 1) < 2**31 / math.sqrt(size):
            part = n * z - rest
            return (part * part).sum(axis=1).tolist()
        part = n * z.astype(object) - rest.astype(object)
        return [int(v) if v < 2**63 else None for v in (part * part).sum(axis=1)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                held, _, x = whole_numbers(part.column("embedding"), size)
                z = x - middle
                scores = (z - rest / n) @ vectors.T / roots
                yield pa.record_batch([part.column("vec_id").take(pa.array(held)), pa.array(deviations(z), pa.int64()), pa.array(scores.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "scores"])

    kept = min(len(values), components)
    schema = "vec_id long, deviation long, scores array<double>"
    if not kept:
        table = spark.createDataFrame([], schema)
    else:
        table = stored(rows.mapInArrow(project, schema), "whitened")
    means = table.agg(*[F.avg(F.col("scores")[i]).alias(f"m{i}") for i in range(kept)]).head() if kept else []
    pairs = [(i, j) for i in range(kept) for j in range(i + 1)]
    cells = table.agg(*[F.avg((F.col("scores")[i] - means[i]) * (F.col("scores")[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).head() if kept else []
    error = max([abs(cell - (i == j)) for (i, j), cell in zip(pairs, cells)], default=0.0)
    shares = F.array(*[F.lit(float(v) / float(total)) for v in values]) if kept else F.array().cast("array<double>")
    return table.select("vec_id", "deviation", F.posexplode("scores").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
