"""Window statistics in the state store: late rows, open windows, restarts."""

import datetime

import pytest
from pyspark.sql import functions as F

from stopwise.operators import logs
from stopwise.streaming import jobs, windows
from tests.helpers import frame

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id string, timestamp timestamp_ntz, web_order_id string, driver_id string, predicted_service_time double, model_version string, request_id string"


def deliver(spark, log, hours, run):
    rows = [(f"{run}-{i}", START + datetime.timedelta(hours=h), "o", "d", value, version, "r") for i, (h, value, version) in enumerate(hours)]
    logs.append(frame(spark, rows, SCHEMA).repartition(3, "id"), log, run)


def expected(*deliveries):
    found = {}
    for hours in deliveries:
        for h, value, version in hours:
            entry = found.setdefault((int(h), version), [0, 0.0, 0])
            entry[0] += 1
            if value is not None:
                entry[1] += value
                entry[2] += 1
    return {key: (n, total / known if known else None) for key, (n, total, known) in found.items()}


def held(spark, places):
    rows = windows.windows(spark, places).withColumn("hour", ((F.unix_timestamp("window_start") - F.unix_timestamp(F.lit(START))) / 3600).cast("int"))
    return {(row["hour"], row["model_version"]): row for row in rows.collect()}


FIRST = [(0.1, 1.0, "a"), (0.2, 3.0, "a"), (1.5, None, "a"), (30.0, 5.0, None), (29.5, 2.0, "b")]
SECOND = [(0.3, 8.0, "a"), (31.0, 1.0, "b"), (30.2, 7.0, None), (80.0, 4.0, "b"), (2.0, 9.0, "b")]
THIRD = [(79.0, 6.0, "b"), (0.9, None, "a"), (55.9, 2.0, "a"), (56.0, 2.5, "a")]


@pytest.fixture
def setting(tmp_path):
    return windows.Places(str(tmp_path / "statistics")), str(tmp_path / "log")


def test_every_row_counts_once(spark, setting):
    """Rows out of order, later than the watermark, without value or version; windows still open."""
    places, log = setting
    for run, hours in (("one", FIRST), ("two", SECOND), ("three", THIRD)):
        deliver(spark, log, hours, run)
        windows.run(jobs.read_predictions(spark, log), places)
    got = held(spark, places)
    assert {key: (row["predictions"], row["avg_prediction"]) for key, row in got.items()} == expected(FIRST, SECOND, THIRD)
    late = {key: row["late"] for key, row in got.items() if row["late"]}
    assert late == {(0, "a"): 2, (2, "b"): 1, (55, "a"): 1}  # watermarks 6 h, then 56 h: the window that ends there is closed
    assert not got[(56, "a")]["closed"] and not got[(80, "b")]["closed"] and got[(31, "b")]["closed"]


def test_closed_windows_leave_the_state(spark, setting):
    places, log = setting
    deliver(spark, log, FIRST, "one")
    windows.run(jobs.read_predictions(spark, log), places)
    assert windows.open_windows(spark, places).count() == 2
    assert spark.read.parquet(places.of("closed")).count() == 2


@pytest.mark.parametrize("broken", ["corrections", "marks"])
def test_restart_after_a_failure(spark, setting, monkeypatch, broken):
    """A batch that fails between its parts runs again; nothing is lost or counted twice."""
    places, log = setting
    deliver(spark, log, FIRST, "one")
    windows.run(jobs.read_predictions(spark, log), places)
    deliver(spark, log, SECOND, "two")
    whole = windows.Places.of

    def failing(self, name):
        if name == broken and seen.pop(name, 0):
            raise RuntimeError("lost")
        seen[name] = 1 if name == broken and name in seen else 0
        return whole(self, name)

    seen = {broken: 1}
    monkeypatch.setattr(windows.Places, "of", failing)
    with pytest.raises(Exception):
        windows.run(jobs.read_predictions(spark, log), places)
    monkeypatch.setattr(windows.Places, "of", whole)
    windows.run(jobs.read_predictions(spark, log), places)
    windows.run(jobs.read_predictions(spark, log), places)
    got = held(spark, places)
    assert {key: (row["predictions"], row["avg_prediction"]) for key, row in got.items()} == expected(FIRST, SECOND)


def test_no_rows(spark, setting):
    places, log = setting
    frame(spark, [], SCHEMA).withColumns({"log_date": F.lit("2024-01-01").cast("date"), "run_id": F.lit("x")}).write.parquet(log)
    windows.run(jobs.read_predictions(spark, log), places)
    assert windows.windows(spark, places).count() == 0
