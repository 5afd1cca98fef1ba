import datetime

import pytest
from pyspark.sql import functions as F

from stopwise.operators import clean, features
from stopwise.plans.processing import process_tables
from stopwise.config import Settings
from stopwise.sources import sample_tables
from stopwise.sources.tables import conform
from tests.helpers import collected, frame, make_tables


def test_target_rules(spark):
    df = frame(spark, [(v,) for v in (None, float("nan"), -1.0, 0.0, 0.5)], "service_time_in_minutes double")
    assert collected(clean.keep_positive_target(df)) == [(0.5,)]


def test_fill_missing_only_existing_columns(spark):
    df = frame(spark, [(None, None)], "floor double, has_elevator boolean")
    assert collected(clean.fill_missing(df)) == [(0.0, False)]


def test_outlier_bounds_are_closed_and_parts_complete(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = frame(spark, [(v,) for v in values], "service_time_in_minutes double")
    bounds = clean.iqr_bounds(df)
    assert (bounds.q1, bounds.q3, bounds.lower, bounds.upper) == (2.0, 4.0, -1.0, 7.0)
    kept = clean.remove_outliers(df)
    outside, _ = clean.detect_outliers(df)
    assert collected(kept) == [(1.0,), (2.0,), (3.0,), (4.0,)] and collected(outside) == [(100.0,)]
    edge = clean.remove_outliers(df, bounds=clean.Bounds(2.0, 4.0, 1.0, 4.0))
    assert edge.count() == 4


def test_outlier_range_reaches_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "visits")
    sample_tables.service_times(spark, sf_dir).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = clean.remove_outliers(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(service_time_in_minutes" in plan and "LessThanOrEqual(service_time_in_minutes" in plan


def test_time_parts(spark):
    rows = [(datetime.datetime(2024, 1, 6, 13, 5),), (datetime.datetime(2024, 1, 8, 0, 0),), (None,)]
    df = frame(spark, rows, "order_time timestamp_ntz")
    got = features.add_time_features(df).select("order_hour", "order_day_of_week", "order_month", "is_weekend")
    assert collected(got) == [(0, 0, 1, 0), (13, 5, 1, 1), (None, None, None, 0)]


def test_bad_time_text_raises(spark):
    df = frame(spark, [("not a time",)], "order_time string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        features.add_time_features(df).collect()


def test_interactions(spark):
    df = frame(
        spark,
        [(2.0, True, False, 2, 500.0), (3.0, False, True, 0, 0.0)],
        "floor double, has_elevator boolean, is_business boolean, total_boxes long, total_weight_g double",
    )
    got = features.add_interactions(df).select(
        "weight_per_box", "floor_elevator_interaction", "business_floor_interaction", "has_elevator", "is_business"
    )
    assert collected(got) == [(0.0, 0.0, 3.0, 0, 1), (250.0, 2.0, 0.0, 1, 0)]


@pytest.mark.parametrize("strategy, fill", [("mean", 3.0), ("median", 2.0), ("mode", 1.0)])
def test_impute(spark, strategy, fill):
    df = frame(spark, [(v,) for v in (1.0, 1.0, 2.0, 2.5, 8.5, None)], "floor double")
    assert (fill,) in collected(clean.impute(df, ["floor"], strategy))
    assert clean.impute(df, ["floor"], "drop").count() == 5
    with pytest.raises(ValueError):
        clean.impute(df, ["floor"], "guess")


def test_conform_checks_and_casts(spark):
    df = frame(spark, [("a", "d", 1, float("nan"), "x")], "web_order_id string, driver_id string, trip_id int, service_time_in_minutes double, extra string")
    got = conform(df, "service_times")
    assert got.columns == ["web_order_id", "driver_id", "trip_id", "service_time_in_minutes"]
    assert collected(got) == [("a", "d", "1", None)]
    with pytest.raises(ValueError, match="driver_id"):
        conform(df.drop("driver_id"), "service_times")


def test_known_totals(spark):
    """Totals of the processed sample rows."""
    processed = process_tables(sample_tables.tables(spark, "/root/testdata/sf0.01"))
    row = processed.agg(
        F.count(F.lit(1)), F.sum("is_weekend"), F.sum("order_hour"), F.sum("floor"), F.sum("total_boxes")
    ).first()
    assert tuple(row) == (14697, 4195, 167340, 32976.0, 37195)


def test_options(spark):
    visits = [{"web_order_id": str(i), "driver_id": "d", "service_time_in_minutes": v} for i, v in enumerate([4.0, 5.0, 6.0, 7.0, 90.0])]
    tables = make_tables(
        spark, service_times=visits, driver_mapping=[{"web_order_id": "0", "driver_id": "d"}] * 2,
        orders=[{"web_order_id": "1", "floor": 4.0}],
    )
    assert process_tables(tables).count() == 5
    assert process_tables(tables, Settings(remove_outliers=False)).count() == 6
    assert process_tables(tables, dedupe_mapping=True).count() == 4
    assert process_tables(tables, Settings(iqr_multiplier=100.0)).count() == 6
    filled = process_tables(tables, Settings(missing_strategy="median"))
    assert set(collected(filled, "floor")) == {(4.0,)}
