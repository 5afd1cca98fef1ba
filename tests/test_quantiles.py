import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stopwise.functions.bins import magnitude_bin
from stopwise.operators.quantiles import exact_quantiles, grouped_summary, running_counts
from tests.helpers import frame, same

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_linear_interpolation(spark):
    df = frame(spark, [(v,) for v in (1.0, 2.0, 3.0, None, 10.0)], "x double")
    row = exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    assert row["quantiles"] == [1.75, 2.5, 4.75]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(st.sampled_from([0.0, -0.0, 7.0, 7.0000001]), st.floats(-1e12, 1e12, allow_nan=False)), min_size=1, max_size=60
    )
)
def test_large_path_equals_numpy(spark, values):
    df = frame(spark, [(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", PROBABILITIES).first()["quantiles"]
    for q, value in zip(PROBABILITIES, got):
        assert same(value, float(np.quantile(values, q)), 1e-9)


@pytest.mark.parametrize("few_groups", [True, False])
def test_groups_weights_and_nulls(spark, few_groups):
    rows = [("a", float(i % 10), 1 + i % 3) for i in range(50)] + [("b", 5.0, 4), ("b", None, 9), (None, 1.0, 1)]
    df = frame(spark, rows, "g string, x double, w int")
    got = exact_quantiles(df, "x", [0.3, 0.5], ["g"], "w", few_groups)
    found = {row["g"]: row["quantiles"] for row in got.collect()}
    repeated = [x for g, x, w in rows if g == "a" for _ in range(w)]
    assert set(found) == {"a", "b"} and found["b"] == [5.0, 5.0]
    assert all(same(v, float(np.quantile(repeated, q))) for q, v in zip([0.3, 0.5], found["a"]))


def test_group_without_values_stays(spark):
    df = frame(spark, [("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0)], "g string, x double")
    got = grouped_summary(df, ["g"], "x")
    assert sorted(map(tuple, got.select("g", "mean", "median", "count").collect())) == [
        ("a", 2.0, 2.0, 2),
        ("b", None, None, 0),
    ]


def test_running_counts(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in np.round(rng.normal(0, 3, 400), 1)] + [1e9, -1e9, float("nan")]
    df = frame(spark, [(v,) for v in values], "x double")
    got = running_counts(df, "x").orderBy("value").collect()
    known = np.array(values[:-1]) + 0.0
    assert [row["value"] for row in got] == sorted(set(known))
    assert all(row["upto"] == int((known <= row["value"]).sum()) and row["total"] == 402 for row in got)


def test_empty_input(spark):
    df = frame(spark, [], "x double")
    row = exact_quantiles(df, "x", [0.5]).first()
    assert row is None or row["quantiles"] is None or row["quantiles"] == [None]
    assert running_counts(df, "x").count() == 0


def test_bins_keep_the_order(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 500), rng.normal(0, 1e6, 500), rng.uniform(7, 7.001, 500), [0.0]])
    for per_octave in (4096, 4096 * 65536):
        rows = (
            frame(spark, [(float(v),) for v in values], "x double")
            .select("x", magnitude_bin(F.col("x"), per_octave).alias("b"))
            .orderBy("x")
            .collect()
        )
        bins = [row["b"] for row in rows]
        assert bins == sorted(bins)


def test_result_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).select((F.col("id") * 37 % 1001 / 7.0).alias("x"))
    results = {
        tuple(exact_quantiles(df.repartition(n), "x", PROBABILITIES).first()["quantiles"]) for n in (1, 3, 16)
    }
    assert len(results) == 1


@pytest.mark.parametrize("crowded", [0, 5, 1_000_000])
def test_running_counts_of_crowded_bins(spark, crowded):
    """Many values within one coarse bin, taken apart or not, and copies of one value."""
    values = [7 + i * 1e-9 for i in range(50)] * 2 + [3.0] * 40 + [-2.5, 0.0, -0.0, None]
    df = frame(spark, [(v,) for v in values], "x double").repartition(3)
    got = running_counts(df, "x", crowded=crowded).orderBy("value").collect()
    known = np.array([v for v in values if v is not None])
    assert [r["value"] for r in got] == sorted(set(known.tolist()))
    assert all(r["upto"] == int((known <= r["value"]).sum()) and r["total"] == len(known) for r in got)
    assert sum(r["count"] for r in got) == len(known)


def test_values_are_shuffled_once_by_bin(spark):
    """Past the bin totals, one exchange by bin for ordinary bins."""
    plan = running_counts(spark.range(100).selectExpr("id / 7.0 as x"), "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(__bin" in plan
