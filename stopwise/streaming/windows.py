"""Tumbling-window statistics of a prediction log, in Spark's state store.

A run has two steps, each an exactly-once stream of its own:

1. `split_late` adds each micro-batch up by window and version, on the map side first, so
   a crowded window is a few sums for each task. Windows that the watermark (latest time of all
   earlier batches, less the delay) has passed go to the corrections, others on.
2. `close_windows` merges the sums under Spark's own watermark and emits a window once, when
   the watermark passes its end (append mode). Its watermark follows the same times,
   so it never finds anything late.

`windows` adds closed windows, corrections and, from the state store, windows still open:
each row of the log counts once, however late it came.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stopwise.sources.tables import exists
from stopwise.streaming.jobs import run_id_of

SUMS = "start timestamp, end timestamp, model_version string, latest timestamp, predictions long, total double, known long"
CLOSED = "start timestamp, end timestamp, model_version string, predictions long, total double, known long"
MARKS = "latest timestamp"


@dataclass(frozen=True)
class Places:
    """Where a stream of statistics keeps its tables and checkpoints."""

    root: str

    def of(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in ("predictions", "total", "known")]


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def split_late(predictions: DataFrame, places: Places, width: str = "1 hour", delay: str = "1 day") -> StreamingQuery:
    """Window sums of each micro-batch, late ones apart.

    A batch writes three parts under its own name: sums in time, sums too late, and the latest
    time it saw. One that runs again overwrites them; the mark it compares with
    comes from batches before it, whose parts are complete.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_id_of(spark, places.of("split_checkpoint"), batch_id)
        stream, number = run.rsplit("-", 1)
        marks = _rows(spark, places.of("marks"), f"{MARKS}, stream string, batch long")
        earlier = marks.filter((F.col("stream") == stream) & (F.col("batch") < int(number)))
        limit = earlier.agg(F.max("latest") - F.expr(f"INTERVAL {delay}")).first()[0]
        moment = F.col("timestamp").cast("timestamp")
        sums = batch.groupBy(F.window(moment, width).alias("window"), "model_version").agg(
            F.max(moment).alias("latest"),
            F.count(F.lit(1)).alias("predictions"),
            F.sum("predicted_service_time").alias("total"),
            F.count("predicted_service_time").alias("known"),
        )
        sums = sums.select("window.start", "window.end", *sums.columns[1:]).persist()
        try:
            late = (F.col("end") <= F.lit(limit)) if limit is not None else F.lit(False)
            for name, rows in (("in_time", sums.filter(~late)), ("corrections", sums.filter(late))):
                rows.write.mode("overwrite").parquet(f"{places.of(name)}/run_id={run}")
            sums.agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(f"{places.of('marks')}/stream={stream}/batch={number}")
        finally:
            sums.unpersist()

    return (
        predictions.filter(F.col("timestamp").isNotNull()).writeStream.foreachBatch(write)
        .option("checkpointLocation", places.of("split_checkpoint"))
        .trigger(availableNow=True)
        .start()
    )


def close_windows(spark: SparkSession, places: Places, width: str = "1 hour", delay: str = "1 day") -> StreamingQuery:
    """Merge the sums in time; a window leaves the state once, when the watermark passes its end.

    All sums there are make one batch, in which nothing can be late against another.
    """
    sums = spark.readStream.schema(SUMS).parquet(places.of("in_time"))
    merged = sums.withWatermark("latest", delay).groupBy(F.window("latest", width).alias("window"), "model_version").agg(*_sums())
    return (
        merged.select("window.start", "window.end", "model_version", "predictions", "total", "known")
        .writeStream.outputMode("append").format("parquet")
        .option("path", places.of("closed"))
        .option("checkpointLocation", places.of("close_checkpoint"))
        .trigger(availableNow=True)
        .start()
    )


def run(predictions: DataFrame, places: Places, width: str = "1 hour", delay: str = "1 day") -> None:
    """Take in all rows there are; the same call goes on after a failure."""
    split_late(predictions, places, width, delay).awaitTermination()
    close_windows(predictions.sparkSession, places, width, delay).awaitTermination()


def open_windows(spark: SparkSession, places: Places) -> DataFrame:
    """Windows that wait for the watermark, as the state store holds them."""
    state = spark.read.format("statestore").load(places.of("close_checkpoint"))
    named = F.col("value").cast("struct<predictions:bigint,total:double,known:bigint>")  # all three are called `sum` there
    return state.select("key.window.start", "key.window.end", "key.model_version", named.alias("sums")).select("start", "end", "model_version", "sums.*")


def windows(spark: SparkSession, places: Places) -> DataFrame:
    """Count and mean for each window and version, and how many rows came late; open windows included."""
    names = ["start", "end", "model_version", "predictions", "total", "known"]
    none = F.lit(0).cast("long")
    parts = [
        (_rows(spark, places.of("closed"), CLOSED), none, True),
        (_rows(spark, places.of("corrections"), SUMS), F.col("predictions"), True),
        (open_windows(spark, places), none, False),
    ]
    marked = [part.select(*names, late.alias("late"), F.lit(closed).alias("closed")) for part, late, closed in parts]
    rows = reduce(DataFrame.unionByName, marked)
    return rows.groupBy(F.col("start").alias("window_start"), F.col("end").alias("window_end"), "model_version").agg(
        F.sum("predictions").alias("predictions"),
        F.try_divide(F.sum("total"), F.sum("known")).alias("avg_prediction"),
        F.sum("late").alias("late"),
        F.every("closed").alias("closed"),
    )
