import datetime
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stopwise import session
from stopwise.config import FEATURES, TARGET, LearnerParams, Settings
from stopwise.operators import models
from stopwise.plans import training
from stopwise.plans.processing import load_processed
from stopwise.sources import artifacts, sample_tables, tables as store


@pytest.fixture(scope="module")
def run(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("train")
    settings = Settings(
        processed_dir=str(root / "processed"), model_dir=str(root / "models"), learner=LearnerParams(trees=5, learning_rate=0.3)
    )
    tables = sample_tables.tables(spark, sf_dir)
    return settings, tables, training.train(spark, settings, tables, datetime.datetime(2024, 5, 1, 8, 30))


def test_better_than_the_mean(spark, run):
    _, _, trained = run
    assert trained.metrics["test_r2"] > 0 and trained.feature_names == FEATURES
    assert set(trained.metrics) == {f"{part}_{name}" for part in ("train", "val", "test") for name in ("rmse", "mae", "r2")}


def test_same_seed_same_metrics(spark, run):
    settings, _, trained = run
    data, names = load_processed(spark, settings), trained.feature_names
    parts = training.with_split(data)
    model = models.fit(parts.filter("split = 'train'"), models.create_model("gbt", settings.learner, names))
    metrics, _ = training.evaluate(models.predict(parts, model))
    assert metrics == pytest.approx(trained.metrics, rel=1e-6)


def test_artifacts(spark, run):
    settings, _, trained = run
    assert trained.version == "gbt_20240501_083000"
    metrics = artifacts.model_metrics(spark, settings.model_dir, trained.version).first()
    assert metrics["test_metrics"]["rmse"] == pytest.approx(trained.metrics["test_rmse"])
    assert set(metrics["training_metrics"]) == {"rmse", "mae", "r2"} and len(metrics["feature_importance"]) == 16
    scores = [row["importance"] for row in artifacts.read_importance(spark, settings.model_dir).collect()]
    assert scores == sorted(scores, reverse=True) and sum(scores) == pytest.approx(1.0)
    with pytest.raises(LookupError):
        artifacts.model_metrics(spark, settings.model_dir, "other")


def test_load_and_list(spark, run):
    settings, _, trained = run
    model = artifacts.load_model(spark, settings.model_dir)
    assert artifacts.load_model(spark, settings.model_dir) is model
    listed = {row["version"]: row["loaded"] for row in artifacts.list_models(spark, settings.model_dir).collect()}
    assert listed == {"latest": True, trained.version: False}
    data = load_processed(spark, settings)
    a = models.predict(data, model).agg(F.sum("predicted")).first()[0]
    assert a == pytest.approx(models.predict(data, trained.model).agg(F.sum("predicted")).first()[0])
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, settings.model_dir, "missing")


def test_stored_data_is_used_and_pruned(spark, run):
    settings, _, _ = run
    stored = load_processed(spark, settings)
    assert store.read_features(spark, settings.processed_dir).columns == FEATURES
    target = store.read_target(spark, settings.processed_dir)
    plan = target._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{TARGET}:double>" in plan and target.count() == stored.count()


def test_whole_job_where_nothing_is_stored(spark, run, tmp_path):
    _, tables, _ = run
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / store.FILES[name]))
    settings = Settings(raw_dir=str(tmp_path), processed_dir=str(tmp_path / "absent"))
    assert load_processed(spark, settings).count() == load_processed(spark, run[0]).count()
    assert store.load_all(spark, str(tmp_path)).articles.count() == tables.articles.count()


def test_unknown_type(spark):
    with pytest.raises(ValueError, match="unknown model type"):
        models.create_model("neural")
    assert models.create_model("random_forest").getStages()[-1].getNumTrees() == 100
    assert models.create_model("lightgbm").getStages()[-1].getMaxIter() == 100


def test_unknown_time_is_accepted(spark, run):
    _, _, trained = run
    row = spark.createDataFrame([(1.0, None)], "floor double, order_hour int")
    assert models.predict(row, trained.model).first()["predicted"] is not None


def test_cross_validation(spark, run):
    settings, _, _ = run
    search = models.cross_validate(load_processed(spark, settings), params=LearnerParams(trees=2), depths=(1, 3), folds=2)
    assert len(search.avgMetrics) == 2 and search.avgMetrics[1] < search.avgMetrics[0]


@pytest.mark.parametrize("broken", ["write_importance", "write_run", "publish"])
def test_a_run_that_fails_changes_nothing_for_readers(spark, run, tmp_path, monkeypatch, broken):
    settings, _, trained = run
    data = training.with_split(load_processed(spark, settings))
    own = Settings(model_dir=str(tmp_path / broken), learner=LearnerParams(trees=1))
    first = training.train(spark, own, at=datetime.datetime(2024, 5, 1), prepared=(data, trained.feature_names))

    def fail(*_):
        raise OSError("lost")

    def seen():
        model = artifacts.load_model(spark, own.model_dir)
        row = artifacts.model_metrics(spark, own.model_dir).first()
        return model, row["model_version"], row["test_metrics"], row["feature_importance"], artifacts.read_importance(spark, own.model_dir).collect()

    before = seen()
    other = Settings(model_dir=own.model_dir, learner=LearnerParams(trees=2, learning_rate=0.5))
    with monkeypatch.context() as patch:
        patch.setattr(artifacts, broken, fail)
        with pytest.raises(OSError):
            training.train(spark, other, at=datetime.datetime(2024, 6, 1), prepared=(data, trained.feature_names))
    assert seen() == before and before[1] == first.version
    second = training.train(spark, other, at=datetime.datetime(2024, 6, 1), prepared=(data, trained.feature_names))
    after = seen()
    assert after[1] == second.version and after[0] is not before[0] and len(after[3]) == 16
    assert {r["version"] for r in artifacts.list_models(spark, own.model_dir).collect()} == {"latest", first.version, second.version}
    assert artifacts.model_metrics(spark, own.model_dir, first.version).first()["test_metrics"] == before[2]


@pytest.mark.parametrize("learn", [lambda df: models.cross_validate(df, params=LearnerParams(trees=1), depths=(1,), folds=2), lambda df: models.fit(df, models.create_model("random_forest", LearnerParams(trees=1, depth=1)))])
def test_learners_read_vectors_made_once(spark, run, monkeypatch, learn):
    """Learners pass over their input several times, and must not make the vectors each time."""
    read = []
    for learner in (models.CrossValidator, models.RandomForestRegressor):
        fit = learner.fit
        monkeypatch.setattr(learner, "fit", lambda self, df, fit=fit: read.append((df.columns, df.storageLevel.useMemory)) or fit(self, df))
    model = learn(load_processed(spark, run[0]))
    assert read == [(["features", TARGET], True)]
    best = getattr(model, "bestModel", model)
    assert best.stages[0].getInputCols() == FEATURES and best.stages[-1].getOrDefault("maxDepth") == 1


def test_large_files_of_processed_rows_are_split(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("id", *[f"rand({i}) as c{i}" for i in range(4)]).coalesce(1)
    store.write_processed(rows, str(tmp_path / "small"), row_group=1 << 20)
    (path,) = glob.glob(str(tmp_path / "small/full_dataset/*.parquet"))
    groups = [pq.ParquetFile(path).metadata.row_group(i).num_rows for i in range(pq.ParquetFile(path).num_row_groups)]
    assert sum(groups) == 200_000 and max(groups) < 60_000
    assert store.SCAN_GROUP <= int(session.SQL_SETTINGS["spark.sql.files.maxPartitionBytes"].rstrip("m")) << 20
