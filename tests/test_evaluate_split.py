from dataclasses import replace

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stopwise.operators import evaluate, split
from stopwise.operators import baseline
from stopwise.operators.baseline import fit_rule
from tests.helpers import collected, frame, same

SCHEMA = "service_time_in_minutes double, predicted double, split string"


def errors(spark, rows):
    return evaluate.add_errors(frame(spark, rows, SCHEMA))


def test_metrics(spark):
    df = errors(spark, [(1.0, 2.0, "train"), (3.0, 3.0, "train"), (5.0, 3.0, "train"), (4.0, 4.0, "test"), (4.0, 4.0, "test"), (2.0, 1.0, "val"), (2.0, 2.0, "val")])
    got = {row["split"]: row for row in evaluate.metrics_by(df, "split").collect()}
    assert same(got["train"]["rmse"], (5 / 3) ** 0.5) and same(got["train"]["mae"], 1.0) and same(got["train"]["r2"], 1 - 5 / 8)
    assert got["test"]["r2"] == 1.0 and got["val"]["r2"] == 0.0
    whole = evaluate.combined_metrics(evaluate.metrics_by(df, "split")).first()["metrics"]
    assert len(whole) == 9 and same(whole["train_mae"], 1.0)


def test_ranges_keep_empty_ones(spark):
    df = errors(spark, [(5.0, 4.0, ""), (5.1, 5.1, ""), (6.1, 5.1, ""), (101.0, 1.0, "")])
    got = collected(evaluate.errors_by_range(df), "range_no", "row_count", "mae", "r2")
    assert got[0] == (0, 1, 1.0, 0.0) and got[1][1] == 2 and same(got[1][2], 0.5) and same(got[1][3], -1.0)
    assert got[2:] == [(i, 0, None, 0.0) for i in range(2, 6)] + [(6, 1, 100.0, 0.0)]
    boxes = collected(evaluate.error_boxplot_by_range(df), "range_no", "count", "median")
    assert len(boxes) == 7 and boxes[5] == (5, 0, None) and boxes[6] == (6, 1, 100.0)


@pytest.mark.parametrize("r2, verdict", [(0.81, "EXCELLENT"), (0.8, "GOOD"), (0.6, "FAIR"), (0.4, "POOR")])
def test_rating(spark, r2, verdict):
    assert spark.range(1).select(evaluate.rating(F.lit(r2))).first()[0] == verdict


def test_split_is_stable_disjoint_complete(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("web_order_id"))
    first = collected(split.with_split(df))
    assert first == collected(split.with_split(df.repartition(7)))
    shares = Counter(part for _, part in first)
    assert abs(shares["test"] / 5000 - 0.2) < 0.03 and abs(shares["val"] / 5000 - 0.1) < 0.03 and len(first) == 5000
    doubled = split.with_split(df.unionAll(df)).groupBy("web_order_id").agg(F.count_distinct("split").alias("n"))
    assert doubled.filter("n > 1").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.05, 0.37, 1.0])
def test_sample_has_exact_size(spark, share):
    rows = [(str(i), "d", float(i)) for i in range(700)] + [("same", "d", 1.0)] * 300
    df = frame(spark, rows, "web_order_id string, driver_id string, service_time_in_minutes double")
    got = collected(split.exact_sample(df, share))
    assert len(got) == int(1000 * share)
    have = Counter(tuple(row) for row in rows)
    assert all(have[row] >= n for row, n in Counter(got).items())
    assert got == collected(split.exact_sample(df.repartition(5), share))


def test_rule_model(spark):
    rows = [(0.0, 1, 2.0), (0.0, 1, 4.0), (1.0, 0, 9.0)] + [(3.0, 1, float(i)) for i in range(30)]
    df = frame(spark, rows, "floor double, has_elevator int, service_time_in_minutes double")
    new = frame(spark, [(0.0, 1, 0), (1.0, 1, 1), (3.0, 1, 2)], "floor double, has_elevator int, i int")
    want = collected(fit_rule(df).transform(new), "i", "predicted")
    assert want[0] == (0, 3.0) and same(want[1][1], sum(r[2] for r in rows) / len(rows))


def test_spread_rule_join(spark, monkeypatch):
    from functools import partial

    df = frame(spark, [(float(i % 2), 1, float(i)) for i in range(40)], "floor double, has_elevator int, service_time_in_minutes double")
    want = collected(fit_rule(df).transform(df))
    monkeypatch.setattr(baseline, "find_hot_keys", partial(baseline.find_hot_keys, fraction=1.0, min_hits=1, partitions=16))
    assert collected(fit_rule(df).transform(df)) == want


def test_few_cells_need_no_shuffle_of_the_rows(spark):
    df = frame(spark, [(float(i % 4), i % 3 == 0, float(i)) for i in range(40)], "floor double, has_elevator boolean, service_time_in_minutes double")
    rule = fit_rule(df)
    assert rule.few and "Exchange hashpartitioning" not in rule.transform(df)._jdf.queryExecution().executedPlan().toString()
    many = replace(rule, few=False)
    assert collected(rule.transform(df)) == collected(many.transform(df))
