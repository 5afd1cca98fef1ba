"""Level-wise boosted trees against MLlib's, and what a fit keeps and sends."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from stopwise.config import FEATURES, LearnerParams
from stopwise.operators import level_trees, models
from tests.helpers import frame


@pytest.fixture(scope="module")
def vectors(spark):
    rng, rows = random.Random(1), []
    for _ in range(1500):
        a, b, c = float(rng.randint(0, 20)), float(rng.randint(0, 5)), rng.choice([0.1, 0.2, 0.7, 1.5])
        rows.append((a, b, c, 3.0 + (a > 7) * 4 + b * c + (b > 2) * a / 5 + rng.gauss(0, 1)))
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame(spark, rows, "a double, b double, c double, y double"))
    return df.repartition(3).cache()


def test_without_draws_the_trees_are_those_of_mllib(vectors, tmp_path):
    settings = dict(featuresCol="features", labelCol="y", maxIter=6, stepSize=0.3, maxDepth=4, minInstancesPerNode=5)
    theirs = GBTRegressor(predictionCol="theirs", **settings).fit(vectors)
    ours = level_trees.BoostedTrees(predictionCol="ours", checkpointInterval=2, **settings).fit(vectors)
    gap = F.max(F.abs(F.col("ours") - F.col("theirs")))
    assert ours.transform(theirs.transform(vectors)).agg(gap).first()[0] < 1e-9
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())
    ours.write().save(str(tmp_path / "model"))
    again = level_trees.BoostedTreesModel.load(str(tmp_path / "model"))
    assert again.nodes == ours.nodes and again.transform(theirs.transform(vectors)).agg(gap).first()[0] < 1e-9


def test_boosted_trees_are_the_level_wise_ones(vectors, spark, sf_dir):
    """MLlib's learner took some 15 s a tree at 6 GB."""
    assert isinstance(models.create_model("lightgbm").getStages()[-1], level_trees.BoostedTrees)
    from stopwise.plans import catalog

    parts = catalog.split.with_split(catalog._stored(spark, sf_dir))
    model = models.fit(parts.filter("split = 'train'"), models.create_model("gbt", LearnerParams(trees=2)))
    assert len(model.stages[-1].featureImportances) == len(FEATURES)


def test_draws_depend_on_the_seed(vectors):
    def nodes(seed):
        settings = dict(labelCol="y", maxIter=2, maxDepth=3, subsamplingRate=0.5, featureSubsetStrategy="0.6", seed=seed)
        return level_trees.BoostedTrees(**settings).fit(vectors).nodes

    first = nodes(1)
    assert first == nodes(1) != nodes(2)
    roots = [n for n in first if n.place == 0]
    assert len(roots) == 2 and all(600 < n.rows < 900 for n in roots) and roots[0].rows != roots[1].rows


def test_a_task_gives_out_sums_by_node_and_bin(spark, vectors, monkeypatch):
    """Whatever the number of rows; rows lie in blocks, dealt evenly, of two bytes for some columns each."""
    monkeypatch.setattr(level_trees, "BLOCK", 100)
    rows = vectors.selectExpr("array(a, b, c) as x", "y").repartition(12)
    many, ends = level_trees._thresholds(rows, 3, 32, 2)
    sizes = [len(e) + 1 for e in ends]
    assert many == 1500 and sizes == [21, 6, 4]
    packing = level_trees.packed(sizes, 128)
    assert packing.groups == [[0, 1], [2]]
    blocks = level_trees._blocks(rows, ends, packing, 4)
    held = blocks.mapPartitions(lambda own: [[(codes.dtype.itemsize * len(codes), len(errors)) for _, codes, errors in own]]).collect()
    assert len(held) == 4 and sum(n for own in held for _, n in own) == 1500 and {w for own in held for w, _ in own} == {4}
    assert max(sum(n for _, n in own) for own in held) <= 1500 / 4 + 100
    counts, sums = level_trees._sums(blocks, 0, np.zeros(1, int), np.zeros((1, 126), np.uint8), packing, [0, 0], 1.0)
    table = vectors.select("a", "b", "c", "y").toPandas()
    for i, name in enumerate("abc"):
        by = table.groupby(name)["y"].agg(["count", "sum"])
        own = slice(sum(sizes[:i]), sum(sizes[: i + 1]))
        assert counts[0, own].tolist() == by["count"].tolist() and np.allclose(sums[0, own], by["sum"])


def test_ranks_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(level_trees, "GRID", 500)
    monkeypatch.setattr(level_trees, "ROOM", 2000)
    monkeypatch.setattr(level_trees, "BLOCK", 1000)
    rows = spark.range(20_000, numPartitions=3).selectExpr("array(double(id * 7919 % 20000), double(id % 3)) as x", "1.0d as y")
    many, ends = level_trees._thresholds(rows, 2, 32, 3)
    assert many == 20_000 and ends[1] == [0.5, 1.5]
    assert len(ends[0]) == 31 and np.abs(np.array(ends[0]) - np.arange(1, 32) * 625).max() < 200
    with pytest.raises(ValueError, match="no target"):
        level_trees._thresholds(rows.selectExpr("x", "if(x[0] > 5, y, null) as y"), 2, 32, 3)


def test_settings_like_mllibs(vectors):
    names = ["all", "auto", "sqrt", "log2", "onethird", "0.8", "1.0", "3", "99"]
    assert [level_trees.columns_of_a_node(name, 16) for name in names] == [16, 16, 4, 4, 6, 13, 16, 3, 16]
    for wrong in ("most", "0", "1.5", "-0.5"):
        with pytest.raises(ValueError, match="featureSubsetStrategy"):
            level_trees.columns_of_a_node(wrong, 16)
    with pytest.raises(ValueError, match="no rows"):
        level_trees.BoostedTrees(labelCol="y").fit(vectors.limit(0))
    single = level_trees.BoostedTrees(labelCol="y", maxIter=1, minInstancesPerNode=1000).fit(vectors)
    assert len(single.nodes) == 1 and single.nodes[0].value == pytest.approx(vectors.agg(F.avg("y")).first()[0])


def test_one_partition_a_core(spark, vectors, monkeypatch):
    """Fits of 100 trees make 500 short passes; a second task on a core cost a third of a pass."""
    asked, blocks = [], level_trees._blocks
    monkeypatch.setattr(level_trees, "BLOCK", 50)
    monkeypatch.setattr(level_trees, "_blocks", lambda *given: asked.append(given[-1]) or blocks(*given))
    level_trees.BoostedTrees(labelCol="y", maxIter=1, maxDepth=2).fit(vectors)
    assert asked == [spark.sparkContext.defaultParallelism] == [8]


def test_predictions_follow_the_splits(spark):
    """Values at, next to and beyond thresholds, unknown ones, and more leaves than a byte counts."""
    rng = random.Random(4)

    def grown(tree, place, depth):
        if not depth:
            return [level_trees.Node(tree, place, value=rng.uniform(-1, 1))]
        split = level_trees.Node(tree, place, rng.randrange(3), float(rng.randrange(5)), gain=1.0)
        return [split, *grown(tree, 2 * place + 1, depth - 1), *grown(tree, 2 * place + 2, depth - 1)]

    values = [float("-inf"), -0.5, 0.0, 0.5, 1.0, 2.0, 3.0, 3.5, 4.0, 9.0, float("inf"), float("nan")]
    rows = [tuple(rng.choice(values) for _ in range(3)) for _ in range(300)]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(frame(spark, rows, "a double, b double, c double"))
    for depths in ((0,), (2, 5, 1), (9,)):
        nodes = [node for t, depth in enumerate(depths) for node in grown(t, 0, depth)]
        by_place = {(n.tree, n.place): n for n in nodes}

        def walked(row):
            total = 0.0
            for t in range(len(depths)):
                node = by_place[t, 0]
                while node.feature is not None:
                    node = by_place[t, 2 * node.place + (1 if row[node.feature] <= node.threshold else 2)]
                total += node.value
            return total

        model = level_trees.BoostedTreesModel(nodes, 3)
        assert [r["prediction"] for r in model.transform(df).collect()] == [walked((r["a"], r["b"], r["c"])) for r in df.collect()]
        assert [len(ends) <= 5 for ends in level_trees._ends(nodes, 3)] == [True] * 3
