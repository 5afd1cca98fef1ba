"""Requests in, features and predictions out, as table jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from stopwise.config import FEATURES
from stopwise.operators.skew import HotKeys, lookup_join

# The order in which the first of several rows per order is chosen; absent columns are skipped.
FIRST_BY = ["service_time_start", "order_datetime", "driver_id", "service_time_in_minutes"]


def first_per_order(processed: DataFrame) -> DataFrame:
    """One row per order: the smallest by FIRST_BY, nulls first.

    A minimum over a struct combines on the map side, where a row number would sort
    all rows of a crowded order in one task.
    """
    ranked = [name for name in FIRST_BY if name in processed.columns]
    others = [name for name in processed.columns if name not in ranked and name != "web_order_id"]
    whole = F.min(F.struct(*ranked, *others)).alias("row")
    firsts = processed.filter(F.col("web_order_id").isNotNull()).groupBy("web_order_id").agg(whole)
    return firsts.select("web_order_id", *[F.col(f"row.{name}").alias(name) for name in processed.columns if name != "web_order_id"])


def feature_table(processed: DataFrame) -> DataFrame:
    """The lookup side: order id and its sixteen features as doubles, 0.0 where a column is absent."""
    needed = [name for name in [*FIRST_BY, *FEATURES] if name in processed.columns]
    firsts = first_per_order(processed.select("web_order_id", *dict.fromkeys(needed)))
    values = [
        (F.col(name).cast("double") if name in processed.columns else F.lit(0.0)).alias(name) for name in FEATURES
    ]
    return firsts.select("web_order_id", *values)


def extract_features(requests: DataFrame, table: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Requests whose order is known, with features. The driver plays no part in the lookup."""
    return lookup_join(requests, table, "web_order_id", "inner", hot)


def unknown_orders(requests: DataFrame, table: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    return lookup_join(requests, table.select("web_order_id"), "web_order_id", "left_anti", hot)


def batch_status(requests: DataFrame, found: DataFrame, max_batch_size: int = 100) -> DataFrame:
    """Per request batch: size, known orders and verdict. The verdict is a remark; every request is scored."""
    sizes = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("requested"))
    valid = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("known"))
    status = (
        F.when(F.col("requested") > max_batch_size, "batch too large")
        .when(F.col("known") == 0, "no valid orders")
        .otherwise("ok")
    )
    return (
        sizes.join(valid, "request_id", "left")
        .withColumn("known", F.coalesce("known", F.lit(0)))
        .withColumn("status", status)
    )


def score(
    requests: DataFrame,
    table: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    model_version: str = "latest",
    hot_orders: HotKeys | None = None,
) -> DataFrame:
    """Look up, predict, and stamp; unknown orders are left out.

    `model` adds a `predicted` column. The version is recorded as given. Every row
    keeps its place in the batch in `position`.
    """
    predicted = model(extract_features(requests, table, hot_orders))
    return predicted.withColumnRenamed("predicted", "predicted_service_time").withColumn(
        "model_version", F.lit(model_version)
    )


def batch_responses(scored: DataFrame, page_size: int = 100) -> DataFrame:
    """The pages of every batch, with the number of predictions of the whole batch in `batch_count`."""
    totals = scored.groupBy(F.col("request_id").alias("_batch")).agg(F.count(F.lit(1)).alias("batch_count"))
    pages = response_pages(scored, page_size)
    return pages.join(totals, pages["request_id"].eqNullSafe(totals["_batch"])).drop("_batch")


def response_pages(scored: DataFrame, page_size: int = 100) -> DataFrame:
    """The predictions of every batch in request order, in pages.

    A page takes the positions of one multiple of `page_size`, so it never holds more
    rows, whatever the size of the batch.
    """
    answer = F.struct("position", "driver_id", "web_order_id", "predicted_service_time", "model_version", "requested_at")
    page = F.floor(F.col("position") / page_size).alias("page")
    return scored.groupBy("request_id", page).agg(
        F.array_sort(F.collect_list(answer)).alias("predictions"),
        F.count(F.lit(1)).alias("total_count"),
        F.max("requested_at").alias("timestamp"),
    )
