"""Lookups by order id read few row groups; joins of bucketed tables move no row."""

import datetime

import pytest
from pyspark.sql import functions as F

from stopwise.operators import joins, logs
from stopwise.sources import bucketed, sample_tables, tables as store
from stopwise.sources.schemas import PREDICTION_LOGS
from tests.helpers import collected, frame

SCHEMA = "id string, timestamp timestamp_ntz, web_order_id string, driver_id string, predicted_service_time double, model_version string, request_id string"


def scanned(df):
    """Rows that the Parquet scan of a finished query gave out."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_log_lookup_skips_row_groups(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(str(i), start, f"order-{i * 7919 % 50000}", "d", 1.0, "v", "r") for i in range(50000)]
    df = frame(spark, rows, SCHEMA).repartition(4, "id")
    logs.append(df, str(tmp_path / "log"), "one", row_group=64 << 10)
    entries = logs.read(spark, str(tmp_path / "log"), PREDICTION_LOGS)
    found = logs.of_orders(entries, ["order-123", "order-49999", "nobody"])
    assert sorted(r["web_order_id"] for r in found.collect()) == ["order-123", "order-49999"]
    assert 0 < scanned(found) <= 50000 / 4
    # Inside the range of ids, but not there: only the Bloom filter knows.
    missing = logs.of_orders(entries, ["order-123x"])
    assert missing.collect() == [] and scanned(missing) <= 50000 / 10
    assert logs.newest(entries, web_order_id="order-5").count() == 1


def test_lookup_table(spark, tmp_path):
    df = spark.range(60000).select((F.col("id") * 7919 % 60000).cast("string").alias("web_order_id"), F.col("id").alias("floor"))
    store.write_lookup(df.unionByName(spark.createDataFrame([(None, 1)], df.schema)), str(tmp_path / "t"), "web_order_id", row_group=64 << 10)
    found = store.lookup(spark, str(tmp_path / "t"), "web_order_id", ["17", "x", "59999"])
    assert sorted(r["web_order_id"] for r in found.collect()) == ["17", "59999"]
    assert 0 < scanned(found) <= 60000 / 4


def test_bucketed_joins_have_no_exchange(spark, sf_dir, tmp_path):
    raw = sample_tables.tables(spark, sf_dir)
    stored = bucketed.write(raw, str(tmp_path), "plan_test", buckets=4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = bucketed.join_in_buckets(stored.buckets)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
        want = joins.join_datasets(raw)
        assert collected(bucketed.join(stored), *want.columns) == collected(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("partitions", [8, 64])
def test_crowded_orders_stay_out_of_the_buckets(spark, sf_dir, tmp_path, partitions):
    raw = sample_tables.crowded(spark, sf_dir)
    stored = bucketed.write(raw, str(tmp_path), f"crowd_test_{partitions}", buckets=4, fraction=1.0, min_hits=2, partitions=partitions)
    kept = stored.buckets.service_times
    assert kept.filter(F.col("web_order_id").isNull() | (F.col("web_order_id") == "1")).count() == 0
    assert stored.apart.service_times.count() >= raw.service_times.count() / 3
    want = joins.join_datasets(raw)
    assert collected(bucketed.join(stored), *want.columns) == collected(want)


def test_empty_tables(spark, tmp_path):
    raw = sample_tables.tables(spark, "/root/testdata/sf0.001")
    empty = store.Tables(**{name: df.limit(0) for name, df in raw.items()})
    assert bucketed.join(bucketed.write(empty, str(tmp_path), "empty_test", buckets=2)).count() == 0
