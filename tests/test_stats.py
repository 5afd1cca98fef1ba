import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.functions.bins import equal_width_class, half_open_bin, histogram_bin
from stopwise.functions.normal import inverse_normal
from stopwise.operators import distribution, profile, stats
from tests.helpers import collected, frame, make_tables, same


def test_half_open_bins(spark):
    df = frame(spark, [(float(v) if v is not None else None,) for v in (0, 5, 5.1, 100, 100.5, -1, None)], "x double")
    got = [row[0] for row in df.select(half_open_bin(F.col("x"), [0, 5, 10, 15, 20, 25, 30, 100])).collect()]
    assert got == [None, 0, 1, 6, None, None, None]


def test_equal_width_classes(spark):
    df = frame(spark, [(float(v),) for v in (0, 1, 2, 3, 10)], "x double")
    got = [row[0] for row in df.select(equal_width_class(F.col("x"), F.lit(0.0), F.lit(10.0), 5)).collect()]
    assert got == [0, 0, 0, 1, 4]


def test_histogram_last_bin_is_closed(spark):
    values = [0.0, 1.0, 2.0, 2.5, 10.0, 10.0, None, float("nan")]
    df = frame(spark, [(v,) for v in values], "x double")
    got = [row["count"] for row in distribution.histogram(df, F.col("x"), 5).orderBy("bin").collect()]
    assert got == list(np.histogram([v for v in values[:6]], bins=5)[0]) and sum(got) == 6
    alone = distribution.histogram(frame(spark, [(3.0,)] * 4, "x double"), F.col("x"), 4).orderBy("bin").collect()
    assert [row["count"] for row in alone] == list(np.histogram([3.0] * 4, bins=4)[0])


def test_empty_class_stays(spark):
    rows = [(0.0, 1.0), (1.0, 3.0), (10.0, 5.0)]
    df = frame(spark, rows, "total_weight_g double, service_time_in_minutes double")
    assert collected(stats.weight_class_stats(df), "class_no", "mean") == [(0, 2.0), (1, None), (2, None), (3, None), (4, 5.0)]


def test_correlation_skips_nulls_and_constants(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, None, 1.0), (None, 1.0, 1.0)]
    df = frame(spark, rows, "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in stats.correlation_matrix(df, ["a", "b", "c", "absent"]).collect()}
    assert len(got) == 9 and same(got["a", "b"], 1.0) and same(got["b", "a"], 1.0) and same(got["a", "a"], 1.0)
    assert got["a", "c"] is None and got["c", "c"] is None


def test_correlation_equals_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (200, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf = pdf.mask(rng.random((200, 4)) < 0.2)
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in pdf.to_numpy()]
    want = pdf.corr()
    for row in stats.correlation_matrix(frame(spark, rows, "a double, b double, c double, d double"), list("abcd")).collect():
        assert same(row["correlation"], want.loc[row["column_a"], row["column_b"]], 1e-7)


def test_describe(spark):
    df = frame(spark, [(1.0, 1), (2.0, None), (3.0, 5), (10.0, 7)], "x double, n int")
    got = {row["column_name"]: row for row in stats.describe(df, ["x", "n"]).collect()}
    assert (got["x"]["q25"], got["x"]["q50"], got["x"]["q75"]) == (1.75, 2.5, 4.75)
    assert got["n"]["count"] == 3 and same(got["x"]["std"], float(np.std([1, 2, 3, 10], ddof=1)))


def test_value_counts_and_top(spark):
    df = frame(spark, [(True, 1.0), (True, 2.0), (False, 2.0), (None, None)], "has_elevator boolean, floor double")
    got = {row["value"]: (row["count"], row["proportion"]) for row in stats.value_counts(df, ["has_elevator"]).collect()}
    assert got == {"true": (2, 2 / 3), "false": (1, 1 / 3)}
    assert collected(stats.top_values(df, "floor", 1)) == [(2.0, 2)]


def test_boxplot(spark):
    df = frame(spark, [(float(v),) for v in (1, 2, 3, 4, 100)], "x double")
    row = distribution.boxplot(df, "x").first()
    assert (row["q1"], row["median"], row["q3"], row["whisker_low"], row["whisker_high"], row["outliers"]) == (2, 3, 4, 1, 4, 1)


def test_cumulative_distribution(spark):
    df = frame(spark, [(1.0,), (1.0,), (2.0,), (None,)], "x double")
    assert collected(distribution.cumulative_distribution(df, "x"), "value", "cumulative") == [(1.0, 2 / 3), (2.0, 1.0)]


def test_inverse_normal(spark):
    from statistics import NormalDist

    chances = [1e-300, 1e-12, 0.001, 0.07, 0.3, 0.5, 0.9, 0.99999, 1 - 1e-12]
    df = frame(spark, [(p,) for p in chances], "p double")
    for p, row in zip(chances, df.select(inverse_normal(F.col("p"))).collect()):
        assert same(row[0], NormalDist().inv_cdf(p), 1e-7)


def test_qq_points_open_ties(spark):
    values = [1.0] * 5000 + [0.0, 2.0]
    points = distribution.qq_points(frame(spark, [(v,) for v in values], "x double"), "x")
    ranks = [row["rank"] for row in points.orderBy("rank").collect()]
    assert ranks == list(range(1, 5003))
    ends = points.filter("rank in (1, 5002)").orderBy("rank").collect()
    assert [row["ordered_value"] for row in ends] == [0.0, 2.0] and same(ends[0]["theoretical"], -ends[1]["theoretical"], 1e-9)


def test_duplicates_count_null_as_value(spark):
    df = frame(spark, [("a",), (None,), (None,), ("a",)], "web_order_id string")
    assert collected(profile.duplicate_count(df, ["web_order_id"], "t")) == [("t", 2)]


def test_missing_counts_nan(spark):
    df = frame(spark, [(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = collected(profile.missing_by_column(df, "t"), "column_name", "missing_count", "row_count")
    assert got == [("s", 1, 3), ("x", 2, 3)]


def test_funnel(spark):
    visits = [{"web_order_id": str(i), "driver_id": "d", "service_time_in_minutes": v} for i, v in enumerate([4.0, 5.0, 6.0, 7.0, 90.0, -1.0, None])]
    tables = make_tables(spark, service_times=visits, orders=[{"web_order_id": "6"}] * 2, driver_mapping=[{"web_order_id": "6", "driver_id": "d"}] * 3)
    got = {row["stage"]: row["row_count"] for row in profile.row_funnel(tables).collect()}
    assert [got[s] for s in ("start", "orders_joined", "mapping_joined", "target_known", "target_positive", "outliers_removed")] == [7, 8, 12, 6, 5, 4]
    assert got["train"] + got["val"] + got["test"] == 4


@pytest.mark.parametrize("low, high", [(0.0, 0.0)])
def test_constant_measure_falls_in_first_bin(spark, low, high):
    df = frame(spark, [(0.0,)], "x double")
    assert df.select(histogram_bin(F.col("x"), F.lit(low), F.lit(high), 5)).first()[0] == 0
