"""Load, process, store, split, fit, evaluate, save."""

from __future__ import annotations

import datetime
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from stopwise.config import Settings
from stopwise.operators.evaluate import add_errors, metrics_by
from stopwise.operators.features import feature_names
from stopwise.operators.models import create_model, feature_importance, fit, predict
from stopwise.operators.split import with_split
from stopwise.plans.processing import process_tables
from stopwise.sources import artifacts, tables as store
from stopwise.sources.tables import Tables


@dataclass(frozen=True)
class Trained:
    version: str
    model: PipelineModel
    metrics: dict[str, float]
    feature_names: list[str]
    importance: DataFrame


def prepare(spark: SparkSession, settings: Settings, tables: Tables | None = None) -> tuple[DataFrame, list[str]]:
    """Process the raw tables, store the result, and read it back with its parts marked.

    Everything after this reads stored columns; the joins do not run again.
    """
    raw = tables or store.load_all(spark, settings.raw_dir)
    store.write_processed(process_tables(raw, settings), settings.processed_dir)
    stored = store.read_processed(spark, settings.processed_dir)
    parts = with_split(
        stored, seed=settings.seed, test_size=settings.test_size, validation_size=settings.validation_size
    )
    return parts, feature_names(stored)


def evaluate(df: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    """Metrics of all parts at once, from one pass over the predictions."""
    by_split = metrics_by(add_errors(df), "split")
    rows = {row["split"]: row for row in by_split.collect()}
    metrics = {f"{part}_{name}": row[name] for part, row in rows.items() for name in ("rmse", "mae", "r2")}
    return metrics, {part: row["row_count"] for part, row in rows.items()}


def train(
    spark: SparkSession,
    settings: Settings = Settings(),
    tables: Tables | None = None,
    at: datetime.datetime | None = None,
    prepared: tuple[DataFrame, list[str]] | None = None,
) -> Trained:
    """Fit, evaluate and save a model, then publish it; `prepared` is what an earlier `prepare` gave, if there was one."""
    at = at or datetime.datetime.now()
    data, names = prepared or prepare(spark, settings, tables)
    model = fit(data.filter(F.col("split") == "train"), create_model(settings.model_type, settings.learner, names))
    metrics, samples = evaluate(predict(data, model))
    importance = feature_importance(data, model)
    version = artifacts.new_version(settings.model_type, at)
    artifacts.save_model(model, settings.model_dir, version)
    artifacts.write_importance(importance, settings.model_dir, version)
    params = {name: str(value) for name, value in asdict(settings.learner).items()}
    params |= {"n_features": str(len(names)), "random_state": str(settings.seed)}
    artifacts.write_run(
        spark, settings.model_dir, version, settings.model_type, at, names, metrics, params, samples
    )
    artifacts.publish(spark, settings.model_dir, version)
    return Trained(version, model, metrics, names, importance)


