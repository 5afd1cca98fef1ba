"""Boosted trees with penalties, grown leaf by leaf, with a default side for unknown values.

Values fall into bins by quantiles of their feature; unknown ones have a bin of their own. A level of
a tree is one aggregate: sums of gradients by (node, feature, bin), which each task adds up in one array over its
Arrow batches, so a row is never repeated for its features and a crowded node is a few numbers for each task. Only these sums, whose number is fixed by the settings, come to the
driver, which picks splits by penalised gain and tries the unknown on either side. A tree is first opened
to its full depth; of that, the splits are taken best gain first until the leaves are used up, which is what
growing leaf by leaf within that depth gives.

The model is a table of nodes; split counts and gains by feature are aggregates of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stopwise.config import FEATURES, TARGET
from stopwise.session import scratch_path

NODES = "tree int, node int, feature string, threshold double, unknown_left boolean, left int, right int, value double, gain double, rows long"

UNKNOWN = 2**15 - 1  # the bin number of unknown values


@dataclass(frozen=True)
class LeafwiseParams:
    trees: int = 100
    learning_rate: float = 0.05
    leaves: int = 31
    depth: int = 6
    l1: float = 0.1
    l2: float = 0.1
    min_rows: int = 20
    bins: int = 64


@dataclass
class Node:
    gradient: float = 0.0
    rows: int = 0
    feature: int = -1
    cut: int = 0  # bins up to it go left
    unknown_left: bool = True
    gain: float = 0.0
    left: int = 0
    right: int = 0


@dataclass
class Boosted:
    """Trees over named features; edges[f] are the upper ends of the bins of a feature."""

    features: list[str]
    edges: list[list[float]]
    start: float
    params: LeafwiseParams
    trees: list[list[Node]] = field(default_factory=list)

    def leaf_value(self, node: Node) -> float:
        return float(-_shrunk(node.gradient, self.params.l1) / (node.rows + self.params.l2) * self.params.learning_rate)

    def threshold(self, node: Node) -> float:
        """Values up to it go left; a cut behind the last edge parts known values from unknown ones."""
        ends = self.edges[node.feature] if node.feature >= 0 else []
        return ends[node.cut] if node.cut < len(ends) else math.inf

    def predict(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        """Adds the prediction; absent columns are unknown."""
        if not self.trees:
            return df.withColumn(output, F.lit(self.start))
        walk, start, depth = _walker(), self.start, self.params.depth
        trees = [(_arrays(tree, [self.threshold(n) for n in tree]), np.array([self.leaf_value(n) for n in tree])) for tree in self.trees]

        def total(*columns: pd.Series) -> pd.Series:
            values = np.array([c.to_numpy(float) for c in columns])
            known, out = ~np.isnan(values), np.full(values.shape[1], start)
            for tree, leaf in trees:
                out += leaf[walk(tree, values, known, depth)]
            return pd.Series(out)

        return df.withColumn(output, F.pandas_udf(total, "double")(*[_number(df, name) for name in self.features]))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The table of all nodes; leaves have no feature."""
        rows = []
        for t, tree in enumerate(self.trees):
            for i, n in enumerate(tree):
                inner = n.feature >= 0
                name, threshold = (self.features[n.feature], self.threshold(n)) if inner else (None, None)
                rows.append((t, i, name, threshold, n.unknown_left if inner else None, n.left if inner else None, n.right if inner else None, None if inner else self.leaf_value(n), n.gain if inner else None, n.rows))
        return spark.createDataFrame(rows, NODES)


def importance(nodes: DataFrame) -> DataFrame:
    """Features with their number of splits and their total gain, most splits first."""
    found = nodes.filter(F.col("feature").isNotNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
    return found.orderBy(F.desc("splits"), F.desc("gain"), "feature")


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _shrunk(gradient, l1: float):
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)


def _score(gradient, rows, params: LeafwiseParams):
    return _shrunk(gradient, params.l1) ** 2 / (rows + params.l2)


def _walker():
    """The function that finds the node each row ends in. It is made here, not imported, so that tasks carry it with them."""

    def walk(tree: tuple[np.ndarray, ...], values: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
        feature, cut, unknown_left, left, right = tree
        many = values.shape[1]
        values, known, row, node = values.ravel(), known.ravel(), np.arange(many), np.zeros(many, np.int64)
        for _ in range(depth):
            at = np.maximum(feature, 0)[node] * many + row
            below = np.where(known[at], values[at] <= cut[node], unknown_left[node])
            node = np.where(feature[node] < 0, node, np.where(below, left[node], right[node]))
        return node

    return walk


def _arrays(tree: Sequence[Node], cuts: Sequence[float]) -> tuple[np.ndarray, ...]:
    return (
        np.array([n.feature for n in tree]),
        np.array(cuts, float),
        np.array([n.unknown_left for n in tree]),
        np.array([n.left for n in tree]),
        np.array([n.right for n in tree]),
    )


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Different quantiles of each feature, from one aggregate of bounded size."""
    wanted = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(_number(df, name), wanted, 10_000).alias(f"q{i}") for i, name in enumerate(features)]).first()
    return [sorted(set(found[f"q{i}"] or [])) for i in range(len(features))]


def _binned(df: DataFrame, features: Sequence[str], edges: list[list[float]], target: str, start: float) -> DataFrame:
    """Blocks of rows, one for each Arrow batch: targets, scores, and bin numbers feature by feature, as arrays; UNKNOWN for unknown values."""
    ends, unknown = [np.array(e, float) for e in edges], UNKNOWN

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target, *values = [column.to_numpy(zero_copy_only=False).astype(float) for column in batch.columns]  # null is not a number here
            bins = [np.where(np.isnan(v), unknown, np.searchsorted(own, v, "left")).astype(np.int16) for own, v in zip(ends, values)]
            block = target.tobytes(), np.full(len(target), start).tobytes(), b"".join(b.tobytes() for b in bins)
            yield pa.record_batch([pa.array([x], pa.binary()) for x in block], ["target", "score", "bins"])

    picked = df.select(F.col(target).cast("double").alias("target"), *[_number(df, name).alias(f"b{i}") for i, name in enumerate(features)])
    return picked.mapInArrow(place, "target binary, score binary, bins binary")


def best_split(gradient: np.ndarray, rows: np.ndarray, params: LeafwiseParams) -> Node | None:
    """The split of a node with the greatest gain; sums by (feature, bin), the last bin for unknown values.

    Of equal gains the first feature, lowest cut and unknown values on the left win.
    """
    total_g, total_n = gradient[0].sum(), int(rows[0].sum())
    best = None
    for f in range(len(gradient)):
        left_g, left_n = np.cumsum(gradient[f, :-1])[:-1], np.cumsum(rows[f, :-1])[:-1]
        for unknown_left in (True, False) if rows[f, -1] else (True,):
            g, n = (left_g + gradient[f, -1], left_n + rows[f, -1]) if unknown_left else (left_g, left_n)
            able = (n >= params.min_rows) & (total_n - n >= params.min_rows)
            if not able.any():
                continue
            gain = np.where(able, _score(g, n, params) + _score(total_g - g, total_n - n, params) - _score(total_g, total_n, params), -np.inf)
            cut = int(gain.argmax())
            if gain[cut] > 1e-9 and (best is None or gain[cut] > best.gain + 1e-12):
                best = Node(float(total_g), total_n, f, cut, unknown_left, float(gain[cut]))
    return best


def _sums(blocks: DataFrame, tree: Sequence[Node], open_: set[int], params: LeafwiseParams, features: int, level: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gradient sums and row counts by (feature, bin) of the open nodes of a level, from one aggregate.

    A task adds its rows up in one array by (open node, feature, bin) and gives out what is in it.
    Leaves of the full depth need the sums of one feature only.
    """
    counted = features if level < params.depth else 1
    walk, arrays, bins, unknown = _walker(), _arrays(tree, [n.cut for n in tree]), params.bins, UNKNOWN
    number = np.full(len(tree), -1)
    number[sorted(open_)] = np.arange(len(open_))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bins + 1
        g, n = np.zeros((counted, len(open_) * width)), np.zeros((counted, len(open_) * width), np.int64)
        for batch in batches:
            for target, score, held in zip(*(batch.column(c) for c in ("target", "score", "bins"))):
                gradient = np.frombuffer(score.as_buffer()) - np.frombuffer(target.as_buffer())
                places = np.frombuffer(held.as_buffer(), np.int16).reshape(features, -1)
                node = number[walk(arrays, places, places != unknown, level)]
                own = np.flatnonzero(node >= 0)
                if len(own) < len(node):
                    node, gradient, places = node[own], gradient[own], places[:, own]
                node = node * width
                for f in range(counted):
                    cell = node + np.minimum(places[f], bins)
                    g[f] += np.bincount(cell, gradient, g.shape[1])
                    n[f] += np.bincount(cell, minlength=g.shape[1])
        feature, cell = np.nonzero(n)
        yield pa.record_batch([pa.array(x) for x in (cell // width, feature, cell % width, g[feature, cell], n[feature, cell])], ["node", "feature", "bin", "g", "n"])

    cells = blocks.mapInArrow(add, "node long, feature long, bin long, g double, n long").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    names = sorted(open_)
    for row in cells.collect():  # at most nodes x features x bins
        g, n = found.setdefault(names[row["node"]], (np.zeros((counted, bins + 1)), np.zeros((counted, bins + 1), np.int64)))
        g[row["feature"], row["bin"]], n[row["feature"], row["bin"]] = row["g"], row["n"]
    return found


def _advanced(rows: DataFrame, tree: Sequence[Node], values: Sequence[float], params: LeafwiseParams, features: int) -> DataFrame:
    """The rows with the tree's leaf values added to their scores."""
    walk, arrays, leaf, depth, unknown = _walker(), _arrays(tree, [n.cut for n in tree]), np.array(values), params.depth, UNKNOWN

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for score, held in zip(batch.column("score"), batch.column("bins")):
                places = np.frombuffer(held.as_buffer(), np.int16).reshape(features, -1)
                scores.append((np.frombuffer(score.as_buffer()) + leaf[walk(arrays, places, places != unknown, depth)]).tobytes())
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(scores, pa.binary()))

    return rows.mapInArrow(add, rows.schema)


def pruned(tree: list[Node], leaves: int) -> list[Node]:
    """The tree left when its splits are taken best gain first until it has so many leaves."""
    out = [Node(tree[0].gradient, tree[0].rows)]
    agenda = [(-tree[0].gain, 0, 0)] if tree[0].feature >= 0 else []
    while agenda and (len(out) + 1) // 2 < leaves:
        _, old, new = heappop(agenda)
        node = tree[old]
        first = len(out)
        out[new] = Node(node.gradient, node.rows, node.feature, node.cut, node.unknown_left, node.gain, first, first + 1)
        for child, place in ((node.left, first), (node.right, first + 1)):
            out.append(Node(tree[child].gradient, tree[child].rows))
            if tree[child].feature >= 0:
                heappush(agenda, (-tree[child].gain, child, place))
    return out


def _grown(rows: DataFrame, params: LeafwiseParams, features: int) -> list[Node]:
    """A tree opened to its full depth; children of a node follow each other."""
    tree, open_ = [Node()], {0}
    for level in range(params.depth + 1):
        sums = _sums(rows, tree, open_, params, features, level)
        opened = set()
        for place, (g, n) in sorted(sums.items()):
            tree[place].gradient, tree[place].rows = float(g[0].sum()), int(n[0].sum())
            split = best_split(g, n, params) if level < params.depth else None
            if split:
                split.left, split.right = len(tree), len(tree) + 1
                tree[place] = split
                opened |= {split.left, split.right}
                tree += [Node(), Node()]
        open_ = opened
        if not open_:
            break
    return tree


def fit(df: DataFrame, features: Sequence[str] = tuple(FEATURES), target: str = TARGET, params: LeafwiseParams = LeafwiseParams()) -> Boosted:
    """Fit on the rows with a target. Bins and scores are stored, so no tree's work is done twice."""
    spark, features = df.sparkSession, list(features)
    known = df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    edges = bin_edges(known, features, params.bins)
    mean = known.agg(F.avg(F.col(target).cast("double")).alias("m")).first()["m"]
    model = Boosted(features, edges, float(mean or 0.0), params)
    if mean is None:
        return model
    path = scratch_path(spark, "boosting")
    _binned(known, features, edges, target, model.start).write.parquet(f"{path}/0")
    for number in range(params.trees):
        rows = spark.read.parquet(f"{path}/{number}")
        tree = pruned(_grown(rows, params, len(features)), params.leaves)
        model.trees.append(tree)
        if number + 1 < params.trees:
            _advanced(rows, tree, [model.leaf_value(n) for n in tree], params, len(features)).write.parquet(f"{path}/{number + 1}")
    return model
