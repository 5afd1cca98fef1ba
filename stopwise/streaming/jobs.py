"""Scoring a stream of request files, logging it once, and running statistics."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stopwise.operators import logs
from stopwise.operators.scoring import score
from stopwise.operators.skew import find_hot_keys
from stopwise.sources.schemas import PREDICTION_LOGS, REQUESTS

STATISTICS = "start timestamp, end timestamp, model_version string, predictions long, total double, known long, run_id string"


def read_requests(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_id_of(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Names a micro-batch of a stream for good: a new checkpoint is a new stream."""
    stream = json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
    return f"{stream}-{batch_id}"


def score_stream(
    requests: DataFrame,
    table: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    feature_log: str,
    prediction_log: str,
    checkpoint: str,
    model_version: str = "latest",
) -> StreamingQuery:
    """Score each micro-batch against the feature table and write both logs.

    Each batch is a run of its own in the logs: one that runs again after a failure
    replaces its own rows, so nothing is logged twice and no other run is touched. The
    orders of the batch pick their rows of the table first, and crowded ones are split.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        asked = batch.persist()
        try:
            known = asked.filter(F.col("web_order_id").isNotNull())
            wanted = table.join(known.select("web_order_id").distinct(), "web_order_id", "left_semi")
            scored = score(asked, wanted, model, model_version, find_hot_keys(known, ["web_order_id"]))
            logs.append_scored(scored, feature_log, prediction_log, run_id_of(batch.sparkSession, checkpoint, batch_id))
        finally:
            asked.unpersist()

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_predictions(spark: SparkSession, prediction_log: str, files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(PREDICTION_LOGS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(prediction_log)
    )


def write_statistics(predictions: DataFrame, path: str, checkpoint: str, width: str = "1 hour") -> StreamingQuery:
    """Counts and sums per time window and model version, for each micro-batch a part of its own.

    Nothing waits for a watermark: rows may arrive in any order and however late. A
    batch that runs again overwrites its part.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        window = F.window(F.col("timestamp").cast("timestamp"), width)
        parts = batch.groupBy(window.alias("window"), "model_version").agg(
            F.count(F.lit(1)).alias("predictions"),
            F.sum("predicted_service_time").alias("total"),
            F.count("predicted_service_time").alias("known"),
        )
        part = f"{path.rstrip('/')}/run_id={run_id_of(batch.sparkSession, checkpoint, batch_id)}"
        parts.select("window.start", "window.end", "model_version", "predictions", "total", "known").write.mode("overwrite").parquet(part)

    return (
        predictions.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def hourly_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The parts added up: count and mean per window and version, open windows included."""
    parts = spark.read.schema(STATISTICS).parquet(path)
    return parts.groupBy(F.col("start").alias("window_start"), F.col("end").alias("window_end"), "model_version").agg(
        F.sum("predictions").alias("predictions"), F.try_divide(F.sum("total"), F.sum("known")).alias("avg_prediction")
    )
