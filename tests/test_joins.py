import random

import pytest
from pyspark.sql import functions as F

from stopwise.operators import joins
from stopwise.operators.articles import aggregate_articles
from stopwise.operators.skew import find_hot_keys, lookup_join
from tests.helpers import collected, frame, make_tables, pandas_rows

ALL_HOT = dict(fraction=1.0, min_hits=2, partitions=64)


def test_null_keys(spark):
    tables = make_tables(
        spark,
        service_times=[{"web_order_id": k, "driver_id": "d"} for k in ("a", None, None)],
        orders=[{"web_order_id": k, "floor": f} for k, f in ((None, 7.0), ("a", 1.0))],
    )
    plain = joins.join_orders(tables)
    assert collected(plain, "web_order_id", "floor") == [("a", 1.0), (None, None), (None, None)]
    met = joins.join_orders(tables, null_safe=True)
    assert collected(met, "web_order_id", "floor") == [("a", 1.0), (None, 7.0), (None, 7.0)]


def test_null_keys_do_not_multiply(spark):
    tables = make_tables(
        spark,
        service_times=[{"web_order_id": None, "driver_id": "d"}] * 300,
        orders=[{"web_order_id": None, "floor": 1.0}] * 300,
    )
    assert joins.join_orders(tables).count() == 300
    assert joins.join_orders(tables, null_safe=True).count() == 90000


def test_empty_text_is_not_null(spark):
    tables = make_tables(
        spark, service_times=[{"web_order_id": ""}, {"web_order_id": None}], orders=[{"web_order_id": "", "floor": 2.0}]
    )
    assert collected(joins.join_orders(tables), "web_order_id", "floor") == [("", 2.0), (None, None)]


def test_article_rollup_nulls(spark):
    tables = make_tables(
        spark,
        articles=[
            {"web_order_id": "a", "box_id": "1", "article_id": "x", "article_weight_in_g": 100.0},
            {"web_order_id": "a", "box_id": "1", "article_id": "y", "article_weight_in_g": 300.0},
            {"web_order_id": "a", "box_id": "2", "article_id": None, "article_weight_in_g": None},
            {"web_order_id": "b", "box_id": None, "article_id": "x", "article_weight_in_g": None},
            {"web_order_id": None, "box_id": "1", "article_id": "x", "article_weight_in_g": 5.0},
        ],
    )
    assert collected(aggregate_articles(tables.articles)) == [
        ("a", 2, 2, 400.0, 200.0, 300.0, 100.0),
        ("b", 0, 1, 0.0, None, None, None),
    ]


def test_overlapping_column_gets_suffix(spark):
    tables = make_tables(
        spark,
        service_times=[{"web_order_id": "a", "customer_id": "visit"}],
        orders=[{"web_order_id": "a", "customer_id": "order"}],
    )
    assert collected(joins.join_orders(tables), "customer_id", "customer_id_order") == [("visit", "order")]


def test_mapping_fans_out_and_is_checked(spark):
    tables = make_tables(
        spark,
        service_times=[{"web_order_id": "a", "driver_id": "d"}, {"web_order_id": "b", "driver_id": "d"}],
        driver_mapping=[{"web_order_id": "a", "driver_id": "d"}] * 3 + [{"web_order_id": "b", "driver_id": "e"}],
    )
    assert collected(joins.join_mapping(tables), "web_order_id") == [("a",)] * 3 + [("b",)]
    assert collected(joins.check_mapping(tables), "web_order_id", "mapping_check") == [("a", "both")] * 3 + [
        ("b", "left_only")
    ]
    assert joins.join_datasets(tables, dedupe_mapping=True).count() == 2


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of each table on one key, nulls, doubled orders and doubled pairs."""
    chance = random.Random(5)

    def key(hot):
        return hot if chance.random() < 0.35 else chance.choice([None, *map(str, range(20))])

    visits = [
        {
            "web_order_id": key("hot"),
            "driver_id": "d0" if chance.random() < 0.5 else f"d{chance.randrange(6)}",
            "service_time_in_minutes": float(i),
        }
        for i in range(300)
    ]
    orders = [{"web_order_id": str(i), "floor": float(i)} for i in range(15)]
    orders += [{"web_order_id": "busy", "floor": 90.0 + i} for i in range(10)]
    orders += [{"web_order_id": "3", "floor": 50.0 + i} for i in range(12)] + [{"web_order_id": "hot", "floor": 1.0}]
    articles = [
        {"web_order_id": key("hot"), "box_id": f"b{chance.randrange(4)}", "article_id": "x", "article_weight_in_g": float(i)}
        for i in range(300)
    ]
    mapping = [{"web_order_id": key("hot"), "driver_id": f"d{chance.randrange(6)}"} for _ in range(120)]
    return make_tables(spark, orders, articles, visits, mapping)




def test_spread_join_equals_brute_force(spark, crowded):
    visits, orders = crowded.service_times.toPandas(), crowded.orders.toPandas()
    articles, mapping = crowded.articles.toPandas(), crowded.driver_mapping.toPandas()
    totals = articles.groupby("web_order_id").agg(
        total_boxes=("box_id", "nunique"), total_weight_g=("article_weight_in_g", "sum")
    )
    want = visits.merge(orders, on="web_order_id", how="left", suffixes=("", "_order"))
    want = want.merge(totals.reset_index(), on="web_order_id", how="left")
    want = want.merge(mapping, on=["driver_id", "web_order_id"], how="left")
    names = ["web_order_id", "driver_id", "service_time_in_minutes", "floor", "total_boxes", "total_weight_g"]
    want[["floor", "total_boxes", "total_weight_g"]] = want[["floor", "total_boxes", "total_weight_g"]].astype(float)
    expected = pandas_rows(want, names)

    skew = joins.measure_skew(crowded, True, **ALL_HOT)
    assert skew.visits is not None and skew.visit_pairs is not None and skew.orders is not None
    for plan in (joins.SkewPlan(), skew):
        got = joins.join_datasets(crowded, True, plan).withColumn("total_boxes", F.col("total_boxes").cast("double"))
        assert collected(got, *names) == expected
    weights = joins.row_weights(crowded, True, skew)
    assert weights.agg(F.sum("row_weight")).first()[0] == len(expected)
    checked = joins.check_mapping(crowded, True, skew)
    assert collected(checked) == collected(joins.check_mapping(crowded, True))


def test_hot_rows_land_in_many_pieces(spark, crowded):
    skew = joins.measure_skew(crowded, **ALL_HOT)
    side = joins._visit_side(crowded.service_times, True, skew).filter(F.col("web_order_id") == "hot")
    biggest = side.groupBy(joins.SPREAD).count().agg(F.max("count")).first()[0]
    assert biggest < side.count() / 4


def test_hot_rows_are_joined_in_many_tasks(spark):
    """The spread survives planning: no task gets most rows of the hot order."""
    visits = [{"web_order_id": "hot" if i % 3 else f"o{i}", "driver_id": f"d{i % 50}"} for i in range(3000)]
    articles = [{"web_order_id": v["web_order_id"], "box_id": "b", "article_id": "x"} for v in visits]
    tables = make_tables(spark, [{"web_order_id": "hot"}], articles, visits, [{"web_order_id": "hot", "driver_id": "d1"}])
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("-1", "false", "16")):
            spark.conf.set(name, value)
        skew = joins.measure_skew(tables, **ALL_HOT)

        def biggest(df):
            return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]

        assert biggest(joins.join_datasets(tables)) >= 2000
        assert biggest(joins.join_datasets(tables, skew=skew)) < 700
        table = aggregate_articles(tables.articles)
        hot = find_hot_keys(tables.service_times, ["web_order_id"], **ALL_HOT)
        assert biggest(lookup_join(tables.service_times, table, "web_order_id", "inner", hot)) < 700
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_hot_keys_are_few_and_found(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    hot = find_hot_keys(df, ["k"], fraction=0.5, partitions=100)
    rows = hot.frame.collect()
    assert [row["k"] for row in rows] == ["hot"] and 120 <= rows[0]["pieces"] <= 150
    assert find_hot_keys(spark.range(1000).select(F.col("id").alias("k")), ["k"], fraction=1.0) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_lookup_join(spark, how):
    keys = ["hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 7}" for i in range(90)]
    left = frame(spark, [(k, i) for i, k in enumerate(keys)], "k string, i int")
    right = frame(spark, [("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    hot = find_hot_keys(left, ["k"], fraction=1.0, min_hits=1, partitions=20)
    assert {row["k"] for row in hot.frame.collect()} >= {"hot", None}
    assert collected(lookup_join(left, right, "k", how, hot)) == collected(left.join(right, "k", how))


def test_fact_rows_are_shuffled_once(spark, sf_dir):
    """Order and pair joins share the partitioning of the visits."""
    from stopwise.sources import sample_tables

    tables = sample_tables.tables(spark, sf_dir)
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = joins.join_datasets(tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    # customer and orders of the sample tables, orders, visits, and two each for the
    # mapping (by pair, by order) and the articles (by order and box, by order).
    assert plan.count("Exchange hashpartitioning") <= 8
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
