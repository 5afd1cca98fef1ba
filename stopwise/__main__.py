"""Jobs for spark-submit: python -m stopwise <job> [options]."""

from __future__ import annotations

import argparse
import uuid
from dataclasses import replace

from pyspark.sql import SparkSession, functions as F

from stopwise.config import Settings
from stopwise.operators import logs, models, profile, scoring
from stopwise.operators.skew import find_hot_keys
from stopwise.plans import training
from stopwise.plans.processing import load_processed
from stopwise.session import tune
from stopwise.sources import artifacts, tables
from stopwise.sources.schemas import PREDICTION_LOGS, REQUESTS


def _train(spark: SparkSession, settings: Settings, options: argparse.Namespace) -> None:
    trained = training.train(spark, settings)
    print(trained.version)
    for name, value in sorted(trained.metrics.items()):
        print(f"{name}: {value:.4f}")


def _summary(spark: SparkSession, settings: Settings, options: argparse.Namespace) -> None:
    profile.data_summary(tables.load_all(spark, settings.raw_dir)).show(200, truncate=False)


def _score(spark: SparkSession, settings: Settings, options: argparse.Namespace) -> None:
    requests = spark.read.schema(REQUESTS).parquet(options.requests)
    model = artifacts.load_model(spark, settings.model_dir, options.version)
    scored = scoring.score(
        requests,
        scoring.feature_table(load_processed(spark, settings)),
        lambda df: models.predict(df, model),
        options.version,
        find_hot_keys(requests.filter(F.col("web_order_id").isNotNull()), ["web_order_id"]),
    )
    logs.append_scored(scored, settings.feature_log, settings.prediction_log, options.run_id or uuid.uuid4().hex)


def _statistics(spark: SparkSession, settings: Settings, options: argparse.Namespace) -> None:
    logs.statistics(logs.read(spark, settings.prediction_log, PREDICTION_LOGS)).show(200, truncate=False)


def _metrics(spark: SparkSession, settings: Settings, options: argparse.Namespace) -> None:
    artifacts.model_metrics(spark, settings.model_dir, options.version).show(truncate=False)


def _expire(spark: SparkSession, settings: Settings, options: argparse.Namespace) -> None:
    for path in (settings.feature_log, settings.prediction_log):
        print(path, logs.expire(spark, path, options.as_of, settings.max_log_age_days))


JOBS = {"train": _train, "summary": _summary, "score": _score, "statistics": _statistics, "metrics": _metrics, "expire": _expire}


def main() -> None:
    defaults = Settings()
    parser = argparse.ArgumentParser(prog="stopwise")
    parser.add_argument("job", choices=sorted(JOBS))
    for name in ("raw_dir", "processed_dir", "model_dir", "feature_log", "prediction_log", "model_type"):
        parser.add_argument(f"--{name.replace('_', '-')}", default=getattr(defaults, name))
    parser.add_argument("--requests", help="Parquet folder of prediction requests")
    parser.add_argument("--version", default="latest")
    parser.add_argument("--run-id", help="name of this run in the logs; the same name again replaces its rows")
    parser.add_argument("--as-of", help="date the log age is counted from; today if not given")
    options = parser.parse_args()
    chosen = {name: value for name, value in vars(options).items() if hasattr(defaults, name)}
    JOBS[options.job](tune(SparkSession.builder.appName("stopwise").getOrCreate()), replace(defaults, **chosen), options)


if __name__ == "__main__":
    main()
