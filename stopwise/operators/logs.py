"""Feature and prediction logs: partitioned Parquet, appended, filtered, summarised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stopwise.config import FEATURES
from stopwise.sources.schemas import FEATURE_VECTOR
from stopwise.sources.tables import ROW_GROUP, exists, findable


def log_id() -> Column:
    """Derived from batch and position, so that a replay yields the same id."""
    return F.sha2(F.concat_ws(":", "request_id", F.col("position").cast("string")), 256)


def features_json() -> Column:
    """The sixteen features as one JSON object, unknown ones as null."""
    values = [F.col(name).cast("double").alias(name) for name in FEATURES]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def parse_features(logs: DataFrame) -> DataFrame:
    parsed = F.from_json("features", FEATURE_VECTOR)
    return logs.withColumn("parsed", parsed).select("*", "parsed.*").drop("parsed", "features")


def feature_log_rows(scored: DataFrame, timestamp: str = "requested_at") -> DataFrame:
    return scored.select(
        log_id().alias("id"),
        F.col(timestamp).alias("timestamp"),
        "web_order_id",
        "driver_id",
        features_json().alias("features"),
        "model_version",
    )


def prediction_log_rows(scored: DataFrame, timestamp: str = "requested_at") -> DataFrame:
    return scored.select(
        log_id().alias("id"),
        F.col(timestamp).alias("timestamp"),
        "web_order_id",
        "driver_id",
        "predicted_service_time",
        "model_version",
        "request_id",
    )


def append(rows: DataFrame, path: str, run_id: str, row_group: int = ROW_GROUP) -> None:
    """Add the rows of one run, under (log_date, run_id).

    Runs never touch each other's rows, so a run needs an id of its own. The same run
    again, after a failure or as a replayed stream batch, replaces what it wrote before,
    also on dates it no longer has. Rows are rebalanced by date: few files for a quiet day,
    several tasks for a busy one. Files are sorted by order id and carry its Bloom
    filters, so that a lookup by id reads few row groups.
    """
    _write(_dealt(rows), path, run_id, row_group)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("log_date", F.to_date("timestamp")).hint("rebalance", "log_date")


def _write(rows: DataFrame, path: str, run_id: str, row_group: int = ROW_GROUP) -> None:
    if not run_id or "/" in run_id:
        raise ValueError("a log run needs an id of its own, without a slash")
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in files.globStatus(hadoop.Path(f"{path.rstrip('/')}/log_date=*/run_id={run_id}")) or []:
        files.delete(old.getPath(), True)
    (
        rows.withColumn("run_id", F.lit(run_id))
        .sortWithinPartitions("log_date", "run_id", "web_order_id")
        .write.mode("append")
        .options(**findable("web_order_id", row_group))
        .partitionBy("log_date", "run_id")
        .parquet(path)
    )


def append_scored(scored: DataFrame, feature_log: str, prediction_log: str, run_id: str) -> None:
    """Both logs of one scored run; the rows are kept meanwhile, so they are computed once. Ids and
    feature texts are made behind the shuffle by date, which moves plain columns."""
    kept = scored.withColumnRenamed("requested_at", "timestamp").persist()
    try:
        dealt = _dealt(kept)
        _write(feature_log_rows(dealt, "timestamp").withColumn("log_date", F.to_date("timestamp")), feature_log, run_id)
        _write(prediction_log_rows(dealt, "timestamp").withColumn("log_date", F.to_date("timestamp")), prediction_log, run_id)
    finally:
        kept.unpersist()


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log table; empty, with its schema, before the first write."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def of_orders(logs: DataFrame, order_ids: Sequence[str]) -> DataFrame:
    """All entries of some orders, as in one request. The ids go down to the scan: row groups whose
    range or Bloom filter excludes them are not read."""
    return logs.filter(F.col("web_order_id").isin(list(order_ids)))


def newest(
    logs: DataFrame,
    web_order_id: str | None = None,
    driver_id: str | None = None,
    limit: int = 100,
    since: str | None = None,
) -> DataFrame:
    """Newest entries first; an empty filter text is no filter, `since` prunes dates."""
    if web_order_id:
        logs = logs.filter(F.col("web_order_id") == web_order_id)
    if driver_id:
        logs = logs.filter(F.col("driver_id") == driver_id)
    if since:
        logs = logs.filter(F.col("log_date") >= F.lit(since).cast("date"))
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def statistics(logs: DataFrame) -> DataFrame:
    """Count and mean overall and per model version, the unnamed version included.

    The overall row is folded from the version rows: one scan, and a row also for an
    empty log.
    """
    versions = logs.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.sum("predicted_service_time").alias("total"),
        F.count("predicted_service_time").alias("known"),
    )
    mean = F.try_divide(F.col("total"), F.col("known")).alias("avg_prediction")
    overall = versions.agg(
        F.coalesce(F.sum("predictions"), F.lit(0)).alias("predictions"),
        F.sum("total").alias("total"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("known"),
    )
    return overall.select(
        F.lit("all").alias("level"), F.lit(None).cast("string").alias("model_version"), "predictions", mean
    ).unionByName(versions.select(F.lit("version").alias("level"), "model_version", "predictions", mean))


def retained(logs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Entries no older than `days` before a date."""
    return logs.filter(F.col("log_date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def expire(spark: SparkSession, path: str, as_of: str | None, days: int) -> list[str]:
    """Delete whole date partitions beyond the age limit, counted from today if no date is given; no kept row is rewritten."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    limit = spark.range(1).select(F.date_sub(today, days).cast("string")).first()[0]
    removed = []
    for entry in files.globStatus(hadoop.Path(f"{path.rstrip('/')}/log_date=*")) or []:
        day = entry.getPath().getName().split("=", 1)[1]
        if day < limit and day[:1].isdigit():
            files.delete(entry.getPath(), True)
            removed.append(day)
    return sorted(removed)
