"""Leaf-wise trees against a plain version that grows them row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.config import LearnerParams
from stopwise.operators import boosting, evaluate, models
from tests.helpers import frame

SCHEMA = "a double, b double, c double, y double"
PARAMS = boosting.LeafwiseParams(trees=3, learning_rate=0.5, leaves=6, depth=5, l1=0.7, l2=1.5, min_rows=4, bins=8)


def rows_of(seed, count=300):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        a, b, c = rng.choice([None, rng.gauss(0, 2)]), float(rng.randint(0, 5)), rng.choice([math.nan, 1.0, 2.0])
        y = (3 if a is None else a) + (b > 2) * 4 + (0 if math.isnan(c) else c) * (b - 1) + rng.gauss(0, 0.2)
        out.append((a, b, c, y))
    return out


def plain(rows, edges, params):
    """Predictions of trees grown best leaf first, every leaf searched again over its own rows."""
    x = np.array([[math.nan if v is None else v for v in row[:3]] for row in rows])
    y = np.array([row[3] for row in rows])
    known = ~np.isnan(x)
    bins = np.array([np.searchsorted(edges[f], x[:, f], "left") for f in range(3)]).T
    shrink = lambda g: np.sign(g) * max(abs(g) - params.l1, 0)
    score = lambda g, n: shrink(g) ** 2 / (n + params.l2)
    prediction = np.full(len(y), y.mean())

    def search(own, depth, gradient):
        best = None
        if depth == params.depth:
            return None
        for f in range(3):
            for cut in range(params.bins - 1):
                for unknown_left in (True, False):
                    left = own[np.where(known[own, f], bins[own, f] <= cut, unknown_left)]
                    right = np.setdiff1d(own, left)
                    if min(len(left), len(right)) < params.min_rows:
                        continue
                    gain = score(gradient[left].sum(), len(left)) + score(gradient[right].sum(), len(right)) - score(gradient[own].sum(), len(own))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, left, right
        return best

    for _ in range(params.trees):
        gradient = prediction - y
        leaves = [(np.arange(len(y)), 0)]
        found = [search(*leaves[0], gradient)]
        while len(leaves) < params.leaves and any(found):
            at = max((i for i, s in enumerate(found) if s), key=lambda i: found[i][0])
            _, left, right = found[at]
            depth = leaves[at][1] + 1
            leaves[at : at + 1] = [(left, depth), (right, depth)]
            found[at : at + 1] = [search(left, depth, gradient), search(right, depth, gradient)]
        for own, _ in leaves:
            prediction[own] -= params.learning_rate * shrink(gradient[own].sum()) / (len(own) + params.l2)
    return prediction


@pytest.mark.parametrize("seed", [1, 2])
def test_trees(spark, seed):
    rows = rows_of(seed)
    df = frame(spark, rows, SCHEMA).withColumn("id", F.monotonically_increasing_id()).repartition(3)
    model = boosting.fit(df, ["a", "b", "c"], "y", PARAMS)
    got = [r["predicted"] for r in model.predict(df).orderBy("id").collect()]
    assert np.abs(np.array(got) - plain(rows, model.edges, PARAMS)).max() < 1e-9
    nodes = model.nodes(spark)
    leaves = nodes.filter("feature IS NULL").groupBy("tree").count().collect()
    assert len(leaves) == 3 and all(r["count"] <= 6 for r in leaves)
    splits = {r["feature"]: r["splits"] for r in boosting.importance(nodes).collect()}
    assert sum(splits.values()) == nodes.filter("feature IS NOT NULL").count() and set(splits) <= {"a", "b", "c"}


def test_penalties_and_limits(spark):
    df = frame(spark, rows_of(3), SCHEMA)
    stiff = boosting.fit(df, ["a", "b", "c"], "y", boosting.LeafwiseParams(trees=1, l1=1e9))
    assert len(stiff.trees[0]) == 1 and stiff.leaf_value(stiff.trees[0][0]) == 0
    alone = boosting.fit(df, ["a", "missing"], "y", boosting.LeafwiseParams(trees=1, leaves=2, min_rows=1))
    assert len(alone.trees[0]) == 3 and {r["feature"] for r in alone.nodes(spark).collect()} == {None, "a"}
    assert boosting.fit(df.limit(0), ["a"], "y").predict(df.limit(1)).first()["predicted"] == 0
    same = boosting.fit(frame(spark, [(1.0, 1.0, 1.0, 5.0)] * 50, SCHEMA), ["a", "b"], "y", boosting.LeafwiseParams(trees=2))
    assert same.predict(df.limit(1)).first()["predicted"] == 5


def test_not_worse_than_level_wise_trees(spark, sf_dir):
    from stopwise.plans import catalog

    parts = catalog.split.with_split(catalog._stored(spark, sf_dir))
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    leafwise = boosting.fit(train, params=boosting.LeafwiseParams(trees=6, learning_rate=0.5, depth=5))
    level = models.fit(train, models.create_model("gbt", LearnerParams(trees=6, learning_rate=0.5)))
    error = lambda df: evaluate.add_errors(df).agg(F.sqrt(F.avg(F.pow("residual", F.lit(2))))).first()[0]
    assert error(leafwise.predict(test)) <= 1.05 * error(models.predict(test, level))


def test_rows_are_held_in_blocks_and_summed_in_tasks(spark):
    df = frame(spark, rows_of(4), SCHEMA).coalesce(1)
    edges = boosting.bin_edges(df, ["a", "b"], 8)
    blocks = boosting._binned(df, ["a", "b"], edges, "y", 0.0)
    assert blocks.count() == 1
    g, n = boosting._sums(blocks, [boosting.Node()], {0}, PARAMS, 2, 0)[0]
    rows = df.collect()
    assert n.sum(axis=1).tolist() == [300, 300] and n[0, -1] == sum(r["a"] is None for r in rows)
    assert np.allclose(g.sum(axis=1), -sum(r["y"] for r in rows))
    assert n[1, 0] == sum(r["b"] <= edges[1][0] for r in rows)
