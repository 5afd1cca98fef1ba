import datetime

import pytest

from pyspark.sql import functions as F

from stopwise.config import FEATURES
from stopwise.operators import logs, monitoring, scoring
from stopwise.sources.schemas import PREDICTION_LOGS, REQUESTS
from tests.helpers import collected, frame, same

DAY = datetime.datetime(2024, 3, 1, 12)


def processed(spark):
    rows = [("a", DAY, "d2", 5.0, 1.0), ("a", DAY, "d1", 9.0, 2.0), ("a", None, "d9", 7.0, 3.0), ("b", DAY, "d1", 4.0, 4.0), (None, DAY, "d1", 4.0, 5.0)]
    return frame(spark, rows, "web_order_id string, order_datetime timestamp_ntz, driver_id string, service_time_in_minutes double, floor double")


def requests(spark, rows):
    return frame(spark, [(batch, i, "x", order, DAY) for i, (batch, order) in enumerate(rows)], REQUESTS)


def constant(df):
    return df.withColumn("predicted", F.col("floor") + 1)


def test_first_per_order(spark):
    assert collected(scoring.first_per_order(processed(spark)), "web_order_id", "floor") == [("a", 3.0), ("b", 4.0)]


def test_lookup_gives_sixteen_doubles_and_rejects(spark):
    table = scoring.feature_table(processed(spark))
    asked = requests(spark, [("r", "a"), ("r", "nope"), ("r", "a"), ("r", None)])
    found = scoring.extract_features(asked, table)
    assert collected(found, "position", "floor", "total_boxes") == [(0, 3.0, 0.0), (2, 3.0, 0.0)]
    assert all(kind == "double" for name, kind in found.dtypes if name in FEATURES)
    assert collected(scoring.unknown_orders(asked, table), "position") == [(1,), (3,)]


def test_batches(spark):
    table = scoring.feature_table(processed(spark))
    asked = requests(spark, [("big", "a")] * 4 + [("none", "nope")] + [("ok", "b"), ("ok", "nope"), ("ok", "a")])
    status = scoring.batch_status(asked, scoring.extract_features(asked, table), max_batch_size=3)
    assert collected(status, "request_id", "status") == [("big", "batch too large"), ("none", "no valid orders"), ("ok", "ok")]
    scored = scoring.score(asked, table, constant, "v1")
    big = [("big", i, 4.0, "v1") for i in range(4)]
    assert collected(scored, "request_id", "position", "predicted_service_time", "model_version") == big + [("ok", 5, 5.0, "v1"), ("ok", 7, 4.0, "v1")]
    answer = {(r["request_id"], r["page"]): r for r in scoring.batch_responses(scored, 3).collect()}
    assert {key: r["total_count"] for key, r in answer.items()} == {("big", 0): 3, ("big", 1): 1, ("ok", 1): 1, ("ok", 2): 1}
    assert [p["web_order_id"] for p in answer[("ok", 1)]["predictions"]] == ["b"]


def test_responses_hold_the_total_of_their_batch(spark):
    table = scoring.feature_table(processed(spark))
    scored = scoring.score(requests(spark, [("big", "a")] * 7 + [(None, "b")] * 2 + [("ok", "b")]), table, constant, "v1")
    answer = {(r["request_id"], r["page"]): (r["total_count"], r["batch_count"]) for r in scoring.batch_responses(scored, 3).collect()}
    assert answer == {("big", 0): (3, 7), ("big", 1): (3, 7), ("big", 2): (1, 7), (None, 2): (2, 2), ("ok", 3): (1, 1)}


def test_logs_round_trip_and_replay(spark, tmp_path):
    table = scoring.feature_table(processed(spark))
    scored = scoring.score(requests(spark, [("r", "a"), ("r", "b")]), table, constant, "v1")
    features, predictions = str(tmp_path / "features"), str(tmp_path / "predictions")
    for _ in range(2):
        logs.append(logs.feature_log_rows(scored), features, "x")
        logs.append(logs.prediction_log_rows(scored), predictions, "x")
    logs.append(logs.prediction_log_rows(scored), predictions, "y")
    with pytest.raises(ValueError):
        logs.append(logs.prediction_log_rows(scored), predictions, "")
    assert spark.read.parquet(features).count() == 2
    stored = logs.read(spark, predictions, PREDICTION_LOGS)
    assert stored.count() == 4 and stored.select("id").distinct().count() == 2
    parsed = logs.parse_features(spark.read.parquet(features))
    assert collected(parsed, "web_order_id", "floor") == [("a", 3.0), ("b", 4.0)]
    assert logs.read(spark, str(tmp_path / "absent"), PREDICTION_LOGS).count() == 0


def test_json_keeps_unknown_features(spark):
    row = frame(spark, [(None,) * 16], ", ".join(f"{name} double" for name in FEATURES)).select(logs.features_json()).first()[0]
    assert row.count("null") == 16


def entries(spark):
    rows = [(str(i), DAY - datetime.timedelta(days=i), f"o{i % 2}", f"d{i % 3}", float(i), "v1" if i % 2 else None, "r") for i in range(6)]
    schema = "id string, timestamp timestamp_ntz, web_order_id string, driver_id string, predicted_service_time double, model_version string, request_id string"
    return frame(spark, rows, schema)


def test_newest(spark):
    assert [r["id"] for r in logs.newest(entries(spark), limit=3).collect()] == ["0", "1", "2"]
    assert [r["id"] for r in logs.newest(entries(spark), web_order_id="o0", driver_id="d2").collect()] == ["2"]
    assert logs.newest(entries(spark), web_order_id="").count() == 6


def test_statistics_with_unnamed_version_and_empty_log(spark):
    got = collected(logs.statistics(entries(spark)), "level", "model_version", "predictions", "avg_prediction")
    assert got == [("all", None, 6, 2.5), ("version", "v1", 3, 3.0), ("version", None, 3, 2.0)]
    assert collected(logs.statistics(entries(spark).limit(0))) == [("all", None, 0, None)]


def test_retention(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append(entries(spark), path, "x")
    stored = logs.read(spark, path, PREDICTION_LOGS)
    assert logs.retained(stored, "2024-03-01", 2).count() == 3
    assert logs.expire(spark, path, "2024-03-01", 2) == ["2024-02-25", "2024-02-26", "2024-02-27"]
    assert logs.read(spark, path, PREDICTION_LOGS).count() == 3
    assert logs.expire(spark, path, None, 2) == ["2024-02-28", "2024-02-29", "2024-03-01"]
    pruned = logs.newest(stored, since="2024-03-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in pruned


def test_monitoring(spark):
    truth = frame(spark, [("o0", "d", 2.0), ("o1", "d", 3.0), ("o1", "d", 5.0), ("o1", "d", -1.0)], "web_order_id string, driver_id string, service_time_in_minutes double")
    got = {r["model_version"]: r for r in monitoring.monitor_accuracy(entries(spark), truth).collect()}
    assert got["v1"]["row_count"] == 3 and same(got["v1"]["mae"], (3 + 1 + 1) / 3)
    scored = frame(spark, [("r", 0, 4.0), ("r", 1, 6.0)], "request_id string, position long, predicted_service_time double")
    other = frame(spark, [("r", 0, 5.0), ("r", 1, 3.0)], "request_id string, position long, predicted_service_time double")
    row = monitoring.compare_versions(scored, other).first()
    assert (row["row_count"], row["mean_difference"], row["mean_abs_difference"], row["max_abs_difference"]) == (2, 1.0, 2.0, 3.0)


def test_drift(spark):
    base = frame(spark, [(float(i),) for i in range(100)], "x double")
    assert same(monitoring.feature_drift(base, base, ["x"]).first()["psi"], 0.0)
    moved = base.select((F.col("x") + 60).alias("x"))
    assert monitoring.feature_drift(base, moved, ["x"]).first()["psi"] > 1
