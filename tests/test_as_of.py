"""The prediction that stood when a visit began."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stopwise.operators import monitoring
from stopwise.operators.skew import find_hot_keys
from tests.helpers import frame

START = datetime.datetime(2024, 1, 1)
VISITS = "visit int, web_order_id string, at timestamp_ntz, __range int"
LOGS = "web_order_id string, timestamp timestamp_ntz, predicted_service_time double, model_version string"


def moment(minutes):
    return None if minutes is None else START + datetime.timedelta(minutes=minutes)


def tables(seed, crowd):
    rng = random.Random(seed)
    orders = ["a", "b", None, "d"] + ["hot"] * crowd
    visits = [(i, rng.choice(orders), rng.choice([None, *range(40)]), i) for i in range(400)]
    said = [(rng.choice(["a", "b", None, "hot", "hot"]), rng.choice([None, *range(40)]), rng.choice([None, 1.0, 2.0]), rng.choice([None, "v", "w"])) for _ in range(120)]
    return visits, said


def brute(visits, said):
    low = lambda x: (x is not None, x)
    out = []
    for i, order, at, extra in visits:
        able = [(t, low(p), low(v)) for o, t, p, v in said if order is not None and o == order and None not in (t, at) and t <= at]
        best = max(able, default=(None, (0, None), (0, None)))
        out.append((i, order, moment(at), extra, best[1][1], best[2][1], moment(best[0])))
    return out


def run(spark, visits, said, hot):
    left = frame(spark, [(i, o, moment(t), x) for i, o, t, x in visits], VISITS)
    right = frame(spark, [(o, moment(t), p, v) for o, t, p, v in said], LOGS)
    keys = find_hot_keys(left, ["web_order_id"], fraction=1.0, min_hits=2, partitions=8) if hot else None
    assert bool(keys) == hot
    return [tuple(r) for r in monitoring.as_of(left, right, "at", keys).collect()]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_as_of(spark, seed, hot):
    visits, said = tables(seed, 6)
    # An input column with a name that the operator uses itself keeps its values.
    assert sorted(run(spark, visits, said, hot), key=lambda r: r[0]) == brute(visits, said)


def test_empty_sides(spark):
    visits, said = tables(1, 1)
    assert run(spark, [], said, False) == []
    assert all(r[4:] == (None, None, None) for r in run(spark, visits, [], False))


def test_crowded_order_is_several_ranges(spark):
    """No partition of the sort holds the whole crowded order."""
    visits = [(i, "hot", i % 1000, 0) for i in range(4000)]
    left = frame(spark, [(i, o, moment(t), x) for i, o, t, x in visits], VISITS)
    right = frame(spark, [("hot", moment(5), 1.0, "v")], LOGS)
    keys = find_hot_keys(left, ["web_order_id"], fraction=1.0, min_hits=2, partitions=8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = monitoring.as_of(left, right, "at", keys)
        sizes = [r["count"] for r in got.filter("predicted = 1.0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == sum(t >= 5 for _, _, t, _ in visits) and len(sizes) > 2 and max(sizes) < 2000
