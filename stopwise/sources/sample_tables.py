"""Delivery tables derived from the star-schema test data.

Each function is a plain projection of the given Parquet tables. Some keys are
left out, doubled or nulled by a modulus rule, so that every null and fan-out
rule of the joins is exercised at any scale.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from stopwise.sources.tables import Tables


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    placed = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        placed.filter("o_orderkey % 101 <> 0")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .selectExpr(
            "cast(o_orderkey as string) as web_order_id",
            "cast(o_custkey as string) as customer_id",
            "cast(c_nationkey as string) as warehouse_id",
            "cast(o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int)) as timestamp_ntz) as order_time",
            "cast(case when o_orderkey % 11 <> 0 then o_custkey % 6 end as double) as floor",
            "case when o_orderkey % 13 <> 0 then o_custkey % 3 = 0 end as has_elevator",
            "case when o_orderkey % 17 <> 0 then c_mktsegment in ('MACHINERY', 'AUTOMOBILE') end as is_business",
        )
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as web_order_id",
        "cast(l_partkey as string) as article_id",
        "cast(l_suppkey % 4 as string) as box_id",
        "case when l_partkey % 29 <> 0 then cast(l_quantity * 100 as double) end as article_weight_in_g",
    )


def service_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as web_order_id",
        "concat('D', cast(o_orderkey % 25 as string)) as driver_id",
        "cast(o_custkey as string) as customer_id",
        "concat('T', cast(o_orderkey % 400 as string)) as trip_id",
        "cast(o_orderdate as timestamp_ntz) as order_datetime",
        """cast(case when o_orderkey % 97 = 0 then null
                     when o_orderkey % 89 = 0 then -1
                     when o_orderkey % 53 = 0 then 60 + o_orderkey % 7
                     else 3 + o_totalprice / 100000 + 0.8 * (o_custkey % 6) end as double)
           as service_time_in_minutes""",
    )


def driver_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with gaps; every 47th pair twice."""
    return (
        _read(spark, sf_dir, "orders")
        .select("o_orderkey")
        .withColumn(
            "copies",
            F.expr("cast(o_orderkey % 31 <> 0 as int) + cast(o_orderkey % 47 = 0 as int)"),
        )
        .filter("copies > 0")
        .selectExpr(
            "concat('D', cast(o_orderkey % 25 as string)) as driver_id",
            "cast(o_orderkey as string) as web_order_id",
            "explode(sequence(1, copies)) as copy",
        )
        .drop("copy")
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        orders=orders(spark, sf_dir),
        articles=articles(spark, sf_dir),
        service_times=service_times(spark, sf_dir),
        driver_mapping=driver_mapping(spark, sf_dir),
    )


def crowded(spark: SparkSession, sf_dir: str) -> Tables:
    """The same tables, ill-behaved: a third of all visits fall on order 1, some ids are
    unknown on both sides, and some orders stand twice with different floors."""
    plain, key = tables(spark, sf_dir), F.col("web_order_id").cast("long")
    visits = plain.service_times.withColumn("web_order_id", F.when(key % 3 == 0, "1").when(key % 101 != 5, F.col("web_order_id")))
    known = plain.orders.withColumn("web_order_id", F.when(key % 103 != 7, F.col("web_order_id")))
    doubled = plain.orders.filter((key % 53 == 0) | (key == 1)).withColumn("floor", F.col("floor") + 1)
    return replace(plain, service_times=visits, orders=known.unionByName(doubled))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests in batches of 60, and some of 150; every ninth order is unknown."""
    return _read(spark, sf_dir, "events").selectExpr(
        """concat('b', cast(case when event_id div 1000 % 5 = 0 then 1000000 + event_id div 150
                                 else event_id div 60 end as string)) as request_id""",
        "event_id as position",
        "concat('D', cast(user_id % 25 as string)) as driver_id",
        """case when event_id % 9 = 0 then concat('X', cast(event_id as string))
                else cast(event_id as string) end as web_order_id""",
        "cast(ts as timestamp_ntz) as requested_at",
    )


def prediction_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "cast(ts as timestamp_ntz) as timestamp",
        "cast(event_id % 500 as string) as web_order_id",
        "concat('D', cast(user_id % 25 as string)) as driver_id",
        "value as predicted_service_time",
        "case when event_id % 10 <> 0 then event_type end as model_version",
        "concat('r', cast(event_id % 100 as string)) as request_id",
    )


def timed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits in the month of the prediction log, to its orders; a third to one order, some without an order or a time."""
    return service_times(spark, sf_dir).selectExpr(
        "web_order_id as visit_id",
        """case when cast(web_order_id as long) % 37 = 5 then null when cast(web_order_id as long) % 3 = 0 then '7'
                else cast(cast(web_order_id as long) % 600 as string) end as web_order_id""",
        """case when cast(web_order_id as long) % 41 <> 9 then timestamp_ntz'2024-01-01 00:00:00'
                + make_interval(0, 0, 0, 0, 0, 0, cast(web_order_id as long) * 7919 % 2592000) end as visited_at""",
        "service_time_in_minutes",
    )
