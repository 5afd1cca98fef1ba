import datetime

import pytest
from pyspark.sql import functions as F

from stopwise.operators import logs, scoring
from stopwise.sources.schemas import PREDICTION_LOGS, REQUESTS
from stopwise.streaming import jobs
from tests.helpers import collected, frame

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def table(spark):
    rows = [(str(i), float(i % 5)) for i in range(50)]
    return scoring.feature_table(frame(spark, rows, "web_order_id string, floor double"))


def model(df):
    return df.withColumn("predicted", F.col("floor") * 2)


def asked(spark, start, count):
    rows = [(f"r{i // 4}", i, "d", str(i % 60), START + datetime.timedelta(minutes=i)) for i in range(start, start + count)]
    return frame(spark, rows, REQUESTS)


def test_stream_equals_batch_and_continues(spark, table, tmp_path):
    incoming, feature_log, prediction_log, checkpoint = (str(tmp_path / name) for name in ("in", "features", "predictions", "checkpoint"))

    def run():
        stream = jobs.read_requests(spark, incoming, files_per_batch=1)
        jobs.score_stream(stream, table, model, feature_log, prediction_log, checkpoint, "v1").awaitTermination()

    asked(spark, 0, 40).repartition(3, "position").write.parquet(incoming)
    run()
    asked(spark, 40, 30).coalesce(1).write.mode("append").parquet(incoming)
    run()
    got = logs.read(spark, prediction_log, PREDICTION_LOGS)
    want = logs.prediction_log_rows(scoring.score(asked(spark, 0, 70), table, model, "v1"))
    assert collected(got, *want.columns) == collected(want)
    assert spark.read.parquet(feature_log).count() == want.count()
    assert got.select("run_id").distinct().count() == 4


def test_new_checkpoint_adds_to_the_logs(spark, table, tmp_path):
    incoming, feature_log, prediction_log = (str(tmp_path / name) for name in ("in", "features", "predictions"))
    asked(spark, 0, 40).coalesce(1).write.parquet(incoming)
    for name in ("one", "two"):
        stream = jobs.read_requests(spark, incoming)
        jobs.score_stream(stream, table, model, feature_log, prediction_log, str(tmp_path / name), "v1").awaitTermination()
    want = logs.prediction_log_rows(scoring.score(asked(spark, 0, 40), table, model, "v1"))
    assert logs.read(spark, prediction_log, PREDICTION_LOGS).count() == 2 * want.count()


@pytest.mark.parametrize("files", [1, 2, 10000])
def test_statistics_hold_every_row(spark, tmp_path, files):
    """Late rows and open windows count, however many files a batch takes."""
    log, out, checkpoint = (str(tmp_path / name) for name in ("log", "out", "checkpoint"))

    def write(hours, run):
        rows = [(f"{run}-{i}", START + datetime.timedelta(hours=h), "o", "d", float(h), "v1", "r") for i, h in enumerate(hours)]
        schema = "id string, timestamp timestamp_ntz, web_order_id string, driver_id string, predicted_service_time double, model_version string, request_id string"
        logs.append(frame(spark, rows, schema).repartition(3, "id"), log, run)
        jobs.write_statistics(jobs.read_predictions(spark, log, files), out, checkpoint).awaitTermination()

    write([0.1, 0.2, 1.5, 5.5], "a")
    write([0.3, 7.5, 30.0], "b")
    got = jobs.hourly_statistics(spark, out).orderBy("window_start").select("predictions", "avg_prediction").collect()
    assert [row["predictions"] for row in got] == [3, 1, 1, 1, 1]
    assert got[0]["avg_prediction"] == pytest.approx(0.2)
