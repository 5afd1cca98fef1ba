"""Boosted regression trees grown level by level, as an estimator with MLlib's meaning of its settings.

What is fitted is what MLlib's `GBTRegressor` fits for squared errors: the first tree to the targets, each later one
to twice the errors that are left, times the step size; a fresh share of the rows for each tree and of the columns for
each node; splits between at most `maxBins` bins of a column, by variance. Other random draws apart, the model is the same.

What a pass costs differs. A row is one number for its error and a few codes of two bytes, each for the bins of several columns;
rows lie in blocks, kept by the executors in one partition for each core. A level is one pass, in which a task adds
up gradients by (node, code) and gives out sums by (node, column, bin); only these, whose number is fixed by the settings, come to the
driver. The pass of a tree's first level also takes the tree before off the errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasCheckpointInterval, HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

NODES = "tree int, place int, feature int, threshold double, value double, gain double, rows long"

GRID = 4096  # different values of a column that a task gives out, or ranks if there are more
ROOM = 1 << 18  # different values of a column that a task holds
BLOCK = 1 << 16  # rows of a block
CODES = 1 << 10  # different codes of the columns that share one


@dataclass
class Node:
    """Places are numbered as in a heap: the children of p are 2 p + 1 and 2 p + 2. Leaves have no feature."""

    tree: int
    place: int
    feature: int | None = None
    threshold: float | None = None
    value: float | None = None
    gain: float | None = None
    rows: int = 0


@dataclass(frozen=True)
class Packing:
    """Which columns share a code; a column's bin is code // stride % size."""

    groups: list[list[int]]
    sizes: list[int]
    widths: list[int]

    def bins_of(self, column: int) -> tuple[int, np.ndarray]:
        """The group of a column and the bin of each of its codes."""
        (g, group), stride = next((g, group) for g, group in enumerate(self.groups) if column in group), 1
        for other in group[group.index(column) + 1 :]:
            stride *= self.sizes[other]
        return g, np.arange(self.widths[g]) // stride % self.sizes[column]


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed, HasCheckpointInterval):
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "greatest number of bins of a column", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least number of rows of a node", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows for each tree", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "columns for each node: a name, a share or a number", TypeConverters.toString)

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(
            maxIter=20, stepSize=0.1, seed=42, checkpointInterval=10, maxDepth=5, maxBins=32, minInstancesPerNode=1, subsamplingRate=1.0, featureSubsetStrategy="all"
        )
        self._set(**settings)


class BoostedTrees(Estimator, _Settings, MLWritable, MLReadable):
    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        nodes, features = _boosted(dataset, self)
        return self._copyValues(BoostedTreesModel(nodes, features))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class BoostedTreesModel(Model, _Settings, MLWritable, MLReadable):
    """A list of nodes; leaf values carry the step size."""

    def __init__(self, nodes: Sequence[Node] = (), features: int = 0):
        super().__init__()
        self.nodes, self.features = list(nodes), features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """A value becomes the number of its column's thresholds below it, so that splits compare small
        numbers and a leaf is chosen among two by arithmetic on them, in bytes as a rule."""
        many, ends = self.features, _ends(self.nodes, self.features)
        trees = [_numbered({node.place: node for node in own}, ends) for own in _by_tree(self.nodes)]
        kind = np.min_scalar_type(max([0, *map(len, ends), *(len(leaves) for _, leaves in trees)])).type

        def total(vectors: pa.Array) -> pa.Array:
            values = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, many).T)
            codes = [np.searchsorted(cuts, column, "left").astype(kind) if len(cuts) else None for cuts, column in zip(ends, values)]

            def below(tree: tuple | int) -> np.ndarray:
                if isinstance(tree, int):
                    return kind(tree)
                column, cut, left, right = tree
                left, right = below(left), below(right)
                return right ^ (left ^ right) * (codes[column] <= kind(cut)).view(np.uint8)

            out = np.zeros(len(vectors))
            for tree, leaves in trees:
                out += leaves.take(below(tree))
            return pa.array(out)

        vectors = vector_to_array(F.col(self.getFeaturesCol()))
        return dataset.withColumn(self.getPredictionCol(), F.arrow_udf(total, "double")(vectors))

    @property
    def featureImportances(self) -> DenseVector:
        """The gains of each column's splits, as shares of all gains."""
        gains = np.zeros(self.features)
        for node in self.nodes:
            if node.feature is not None:
                gains[node.feature] += node.gain
        return Vectors.dense(gains / gains.sum() if gains.any() else gains)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"features": self.model.features})
        rows = [(n.tree, n.place, n.feature, n.threshold, n.value, n.gain, n.rows) for n in self.model.nodes]
        self.sparkSession.createDataFrame(rows, NODES).coalesce(1).write.parquet(f"{path}/nodes")


class _ModelReader(MLReader):
    def load(self, path: str) -> BoostedTreesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "place").collect()
        model = BoostedTreesModel([Node(**row.asDict()) for row in rows], metadata["features"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _by_tree(nodes: Iterable[Node]) -> list[list[Node]]:
    trees: dict[int, list[Node]] = {}
    for node in nodes:
        trees.setdefault(node.tree, []).append(node)
    return [trees[t] for t in sorted(trees)]


def _ends(nodes: Iterable[Node], columns: int) -> list[np.ndarray]:
    """The thresholds of each column that splits use, in order."""
    used: list[set[float]] = [set() for _ in range(columns)]
    for node in nodes:
        if node.feature is not None:
            used[node.feature].add(node.threshold)
    return [np.array(sorted(u), float) for u in used]


def _numbered(nodes: dict[int, Node], ends: list[np.ndarray]) -> tuple[tuple | int, np.ndarray]:
    """A tree as (column, number of the threshold, left, right), a leaf as its number; and the leaves' values."""
    leaves: list[float] = []

    def below(place: int) -> tuple | int:
        node = nodes[place]
        if node.feature is None:
            leaves.append(float(node.value))
            return len(leaves) - 1
        return node.feature, int(np.searchsorted(ends[node.feature], node.threshold)), below(2 * place + 1), below(2 * place + 2)

    return below(0), np.array(leaves)


def _lowest(place: int, inner: int) -> int:
    """Where on the lowest level the rows of a leaf end."""
    while place < inner:
        place = 2 * place + 1
    return place - inner


def columns_of_a_node(strategy: str, columns: int) -> int:
    """How many columns a node may split on, by MLlib's names for it."""
    named = {"auto": columns, "all": columns, "sqrt": math.ceil(math.sqrt(columns)), "log2": math.ceil(math.log2(columns)), "onethird": math.ceil(columns / 3)}
    if strategy in named:
        return max(1, named[strategy])
    try:
        wanted = int(strategy) if strategy.isdigit() else math.ceil(float(strategy) * columns)
    except ValueError:
        wanted = 0
    if wanted < 1 or not strategy.isdigit() and wanted > columns:
        raise ValueError(f"unknown featureSubsetStrategy: {strategy}")
    return min(wanted, columns)


def thresholds_of(values: np.ndarray, counts: np.ndarray, bins: int) -> list[float]:
    """Midpoints between neighbouring values: all of them, or those next to even steps of the count, as MLlib chooses them."""
    if len(values) <= bins:
        return ((values[1:] + values[:-1]) / 2).tolist()
    reached, chosen = counts.cumsum(), []
    step = target = reached[-1] / bins
    for i in range(1, len(values)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            chosen.append(float(values[i - 1] + values[i]) / 2)
            target += step
    return chosen


def _merger(most: int):
    """The function that adds up counted values; of more than `most` those at even ranks stay, with the counts up to them."""

    def merge(values: np.ndarray, counts: np.ndarray, limit: int = most) -> tuple[np.ndarray, np.ndarray]:
        found, own = np.unique(values, return_inverse=True)
        many = np.bincount(own, counts, len(found)).astype(np.int64)
        if len(found) > limit:
            reached = many.cumsum()
            kept = np.unique(np.searchsorted(reached, np.linspace(reached[-1] / most, reached[-1], most)).clip(max=len(found) - 1))
            found, many = found[kept], np.diff(reached[kept], prepend=0)
        return found, many

    return merge


def _thresholds(rows: DataFrame, columns: int, bins: int, partitions: int) -> tuple[int, list[list[float]]]:
    """The number of rows and the thresholds of each column, from one pass over all rows.

    A column with up to GRID different values is counted exactly; each task gives out at most so many.
    """
    merge, most, size = _merger(GRID), ROOM, BLOCK

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, count, unknown = [(np.zeros(0), np.zeros(0, np.int64))] * columns, [], 0, 0

        def add() -> None:
            for c in range(columns):
                found, many = np.unique(np.concatenate([x[:, c] for x in held]), return_counts=True)
                seen[c] = merge(np.concatenate([seen[c][0], found]), np.concatenate([seen[c][1], many]), most)

        for batch in batches:
            held.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            unknown += int(np.isnan(batch.column("y").to_numpy(zero_copy_only=False).astype(float)).sum())
            count += batch.num_rows
            if count >= size:
                add()
                held, count = [], 0
        if held:
            add()
        found = [merge(*s) for s in seen]
        yield pa.record_batch(
            [
                pa.array(range(columns), pa.int32()),
                pa.array([v.tobytes() for v, _ in found], pa.binary()),
                pa.array([n.tobytes() for _, n in found], pa.binary()),
                pa.array([unknown] * columns, pa.int64()),
            ],
            ["c", "found", "many", "unknown"],
        )

    by_column: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(columns)]
    unknown = 0
    for row in rows.coalesce(partitions).mapInArrow(look, "c int, found binary, many binary, unknown long").collect():
        by_column[row["c"]].append((np.frombuffer(row["found"]), np.frombuffer(row["many"], np.int64)))
        unknown += row["unknown"]
    if unknown:
        raise ValueError(f"{unknown // columns} rows have no target")
    merged = [merge(np.concatenate([v for v, _ in own]), np.concatenate([n for _, n in own]), ROOM) for own in by_column]
    return int(merged[0][1].sum()), [thresholds_of(values, counts, bins) for values, counts in merged]


def packed(sizes: Sequence[int], limit: int) -> Packing:
    """Columns that share a code, so that it has at most `limit` values, if one column alone has no more."""
    groups: list[list[int]] = []
    for column in sorted(range(len(sizes)), key=lambda c: -sizes[c]):
        room = (group for group in groups if math.prod(sizes[c] for c in group) * sizes[column] <= limit)
        fitting = next(room, None)
        if fitting is None:
            groups.append([column])
        else:
            fitting.append(column)
    return Packing(groups, list(sizes), [math.prod(sizes[c] for c in group) for group in groups])


def _blocks(rows: DataFrame, ends: list[list[float]], packing: Packing, partitions: int) -> RDD:
    """Blocks of rows, dealt evenly to partitions: their number, codes by group, and targets."""
    cuts, groups, sizes, size = [np.array(e, float) for e in ends], packing.groups, packing.sizes, BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, count, number = TaskContext.get().partitionId(), [], 0, 0

        def block() -> pa.RecordBatch:
            codes, targets = np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held])
            return pa.record_batch([pa.array([x]) for x in (task, number, codes.tobytes(), targets.tobytes())], ["task", "number", "codes", "errors"])

        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.zeros((len(groups), batch.num_rows), np.uint16)
            for g, group in enumerate(groups):
                for c in group:
                    codes[g] = codes[g] * sizes[c] + np.searchsorted(cuts[c], values[:, c], "left").astype(np.uint16)
            held.append((codes, batch.column("y").to_numpy(zero_copy_only=False)))
            count += batch.num_rows
            if count >= size:
                yield block()
                held, count, number = [], 0, number + 1
        if count:
            yield block()

    def read(row: tuple) -> tuple:
        return (row[0], row[1]), np.frombuffer(row[2], np.uint16).reshape(len(groups), -1), np.frombuffer(row[3])

    made = rows.mapInArrow(pack, "task long, number long, codes binary, errors binary")
    turn = F.col("number") * rows.rdd.getNumPartitions() + F.col("task")  # tasks deal in turns, so partitions differ by a few blocks
    return made.repartitionById(partitions, (turn % partitions).cast("int")).sortWithinPartitions("task", "number").rdd.map(read)


def _walker():
    """The function that finds each row's place on a level of a tree. It is made here, not imported, so that tasks carry it with them."""

    def walk(codes: np.ndarray, group: np.ndarray, side: np.ndarray, levels: int) -> np.ndarray:
        many, width = codes.shape[1], side.shape[1]
        flat, sides, row, place = codes.ravel(), side.ravel(), np.arange(many), np.zeros(many, np.int64)
        for level in range(levels):
            first = 2**level - 1
            if level < 2:  # few nodes: both sides of each are looked up for all rows
                turns = [side[at].take(codes[group[at]]) for at in range(first, 2 * first + 1)]
                place = 2 * place + (np.where(place, turns[1], turns[0]) if level else turns[0])
            else:
                at = place + first
                place = 2 * place + sides.take(at * width + flat.take(group.take(at) * many + row))
        return place

    return walk


def _sums(blocks: RDD, level: int, group: np.ndarray, side: np.ndarray, packing: Packing, draw: list[int], rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Row counts and error sums by (node of the level, bin), the bins of one column after those of another."""
    walk, nodes, groups, sizes, widths = _walker(), 2**level, packing.groups, packing.sizes, packing.widths
    starts = np.concatenate([[0], np.cumsum(sizes)])
    group, side = group[: nodes - 1], side[: nodes - 1]

    def add(own: Iterator[tuple]) -> Iterator[np.ndarray]:
        cells = [np.zeros((2, (nodes + 1) * width)) for width in widths]
        for number, codes, errors in own:
            place = walk(codes, group, side, level)
            if rate < 1:  # rows not drawn count for a node that nobody reads
                np.putmask(place, np.random.default_rng([*draw, *number]).random(len(place), np.float32) >= rate, nodes)
            for g, width in enumerate(widths):
                at = place * width + codes[g]
                cells[g][0] += np.bincount(at, minlength=cells[g].shape[1])
                cells[g][1] += np.bincount(at, errors, cells[g].shape[1])
        out = np.zeros((2, nodes, starts[-1]))
        for found, columns, width in zip(cells, groups, widths):
            shaped = found[:, : nodes * width].reshape(2, nodes, *[sizes[c] for c in columns])
            for i, c in enumerate(columns):
                out[:, :, starts[c] : starts[c] + sizes[c]] = shaped.sum(axis=tuple(2 + j for j in range(len(columns)) if j != i))
        yield out

    total = blocks.mapPartitions(add).reduce(lambda a, b: a + b)
    return total[0], total[1]


def _without(blocks: RDD, group: np.ndarray, side: np.ndarray, values: np.ndarray, depth: int) -> RDD:
    """The blocks with a tree's values taken off their errors."""
    walk = _walker()
    return blocks.map(lambda b: (b[0], b[1], b[2] - values.take(walk(b[1], group, side, depth))))


def _forget(blocks: RDD) -> None:
    """Removes the files of a checkpoint."""
    file = blocks.getCheckpointFile()
    if file:
        path = blocks.ctx._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(blocks.ctx._jsc.hadoopConfiguration()).delete(path, True)


def best_split(rows: np.ndarray, sums: np.ndarray, columns: Iterable[int], sizes: Sequence[int], least: int) -> tuple[float, int, int, int, float] | None:
    """Gain, column, cut, and the left side's rows and sum, of a node's best split; of equal gains the first column and lowest cut win."""
    starts, best = np.concatenate([[0], np.cumsum(sizes)]), None
    total_n, total_s = rows[: sizes[0]].sum(), sums[: sizes[0]].sum()
    floor = 1e-12 * total_s**2 / max(total_n, 1)  # below it is rounding
    for c in columns:
        n, s = rows[starts[c] : starts[c + 1] - 1].cumsum(), sums[starts[c] : starts[c + 1] - 1].cumsum()
        able = (n >= max(least, 1)) & (total_n - n >= max(least, 1))
        if able.any():
            n, s, cuts = n[able], s[able], np.flatnonzero(able)
            gain = s**2 / n + (total_s - s) ** 2 / (total_n - n) - total_s**2 / total_n
            i = int(gain.argmax())
            if gain[i] > floor and (best is None or gain[i] > best[0]):
                best = float(gain[i]), c, int(cuts[i]), int(n[i]), float(s[i])
    return best


def _boosted(dataset: DataFrame, settings: _Settings) -> tuple[list[Node], int]:
    trees, depth, seed, rate = settings.getMaxIter(), settings.getOrDefault("maxDepth"), settings.getSeed() % 2**63, settings.getOrDefault("subsamplingRate")
    rows = dataset.select(vector_to_array(F.col(settings.getFeaturesCol())).alias("x"), F.col(settings.getLabelCol()).cast("double").alias("y"))
    first = rows.first()
    if first is None:
        raise ValueError("no rows to fit")
    columns = len(first["x"])
    taken = columns_of_a_node(settings.getOrDefault("featureSubsetStrategy"), columns)
    context = dataset.sparkSession.sparkContext
    cores = context.defaultParallelism
    many, ends = _thresholds(rows, columns, settings.getOrDefault("maxBins"), 2 * cores)
    sizes = [len(e) + 1 for e in ends]
    packing = packed(sizes, max(32, min(CODES, 2**18 >> depth)))
    bins = [packing.bins_of(c) for c in range(columns)]
    # One partition a core: a pass is short, so a second task on a core costs more than it evens out.
    blocks = _blocks(rows, ends, packing, min(math.ceil(many / BLOCK), cores)).persist(StorageLevel.MEMORY_AND_DISK)
    before, every, saved, nodes = None, settings.getCheckpointInterval(), [], []  # of `saved`, the last is what others rest on
    try:
        for t in range(trees):
            # Later trees are fitted to twice the errors: an exact factor, put in where sums are read.
            factor, step = (2.0, settings.getStepSize()) if t else (1.0, 1.0)
            chance = np.random.default_rng([seed, t])
            group, side = np.zeros(2**depth - 1, np.int64), np.zeros((2**depth - 1, max(packing.widths)), np.uint8)
            values, own = np.zeros(2**depth), {0: Node(t, 0)}
            open_, sums = {0}, {}
            for level in range(depth + 1):
                found: set[int] = set()
                if level < depth and open_ or not level:
                    counts, errors = _sums(blocks, level, group, side, packing, [seed, t], rate)
                    if not level:
                        own[0].rows, sums[0] = int(counts[0, : sizes[0]].sum()), float(errors[0, : sizes[0]].sum() * factor)
                        if before is not None:
                            before.unpersist()
                            before = None
                            while len(saved) > 1 and saved[-1].isCheckpointed() or len(saved) > 2:
                                _forget(saved.pop(0))
                for place in sorted(open_) if level < depth else ():
                    at = place - (2**level - 1)
                    chosen = sorted(chance.permutation(columns)[:taken].tolist())
                    split = best_split(counts[at], errors[at] * factor, chosen, sizes, settings.getOrDefault("minInstancesPerNode"))
                    if split:
                        node, (gain, c, cut, left_n, left_s) = own[place], split
                        node.feature, node.threshold, node.gain = c, ends[c][cut], gain
                        group[place], codes = bins[c]
                        side[place, : len(codes)] = codes > cut
                        for child, n, s in ((2 * place + 1, left_n, left_s), (2 * place + 2, node.rows - left_n, sums[place] - left_s)):
                            own[child], sums[child] = Node(t, child, rows=n), s
                            found.add(child)
                open_ = found
            for place, node in own.items():
                if node.feature is None:
                    node.value = step * sums[place] / node.rows if node.rows else 0.0
                    values[_lowest(place, 2**depth - 1)] = node.value
            nodes += [own[place] for place in sorted(own)]
            if t + 1 < trees:
                before, blocks = blocks, _without(blocks, group, side, values, depth).persist(StorageLevel.MEMORY_AND_DISK)
                if every > 0 and (t + 1) % every == 0 and context.getCheckpointDir():
                    blocks.checkpoint()  # or the lineage grows with every tree
                    saved.append(blocks)
    finally:
        for kept in (before, blocks):
            if kept is not None:
                kept.unpersist()
        for kept in saved:
            _forget(kept)
    return nodes, columns
