"""The raw tables in buckets of their order id, so that joins by it need no shuffle.

A bucket is one sorted file; equal ids of all tables are in buckets of the same number. Orders so
crowded that one would fill a bucket, and visits without an id, are kept
apart in plain tables and are joined by shuffle, in pieces, as elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stopwise.operators.articles import aggregate_articles
from stopwise.operators.joins import SkewPlan, join_datasets, measure_skew
from stopwise.operators.rows import repeat_rows
from stopwise.operators.skew import find_hot_keys
from stopwise.session import shuffle_partitions
from stopwise.sources.tables import Tables

KEY = "web_order_id"


@dataclass(frozen=True)
class Bucketed:
    """Ordinary orders in buckets, the rest as it is; `skew` says how to spread that."""

    buckets: Tables
    apart: Tables
    skew: SkewPlan


def crowded_orders(tables: Tables, **sampling) -> DataFrame | None:
    """The orders that do not fit a bucket of some table: for each at most half as many as there are shuffle partitions."""
    found = [find_hot_keys(df, [KEY], **sampling) for _, df in tables.items()]
    frames = [hot.frame.select(KEY).filter(F.col(KEY).isNotNull()) for hot in found if hot]
    return reduce(DataFrame.union, frames).distinct() if frames else None


def write(tables: Tables, path: str, name: str, buckets: int | None = None, **sampling) -> Bucketed:
    """Save the tables as `{name}_{table}` in the catalogue, their files under `path`, and those apart beside them."""
    spark = tables.orders.sparkSession
    buckets = buckets or shuffle_partitions(spark)
    skew = measure_skew(tables, **sampling)
    crowded = crowded_orders(tables, **sampling)
    saved, apart = {}, {}
    for table, df in tables.items():
        known = F.col(KEY).isNotNull()
        if crowded is None:
            plain, rest = df.filter(known), df.filter(~known)
        else:
            listed = F.broadcast(crowded)
            plain = df.filter(known).join(listed, KEY, "left_anti")
            rest = df.filter(known).join(listed, KEY, "left_semi").unionByName(df.filter(~known))
        whole, folder = f"{name}_{table}", f"{path.rstrip('/')}/{table}"
        # One partition for each bucket: the hash is the same, so every bucket is one file.
        writer = plain.select(df.columns).repartition(buckets, KEY).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY)
        writer.option("path", f"{folder}_buckets").saveAsTable(whole)
        rest.select(df.columns).write.mode("overwrite").parquet(f"{folder}_apart")
        saved[table], apart[table] = spark.table(whole), spark.read.schema(df.schema).parquet(f"{folder}_apart")
    return Bucketed(Tables(**saved), Tables(**apart), skew)


def join_in_buckets(tables: Tables) -> DataFrame:
    """All tables joined bucket by bucket: no row moves."""
    visits, orders = tables.service_times, tables.orders
    renamed = [F.col(c).alias(f"{c}_order" if c != KEY and c in visits.columns else c) for c in orders.columns]
    mapped = tables.driver_mapping.groupBy(KEY, "driver_id").agg(F.count(F.lit(1)).alias("__mapping_rows"))
    joined = visits.join(aggregate_articles(tables.articles), KEY, "left").join(mapped, [KEY, "driver_id"], "left")
    joined = joined.join(orders.select(renamed), KEY, "left")
    return repeat_rows(joined, F.coalesce("__mapping_rows", F.lit(1))).drop("__mapping_rows")


def join(stored: Bucketed) -> DataFrame:
    """What `join_datasets` gives for the whole tables."""
    apart = join_datasets(stored.apart, skew=stored.skew)
    return join_in_buckets(stored.buckets).select(apart.columns).unionByName(apart)
