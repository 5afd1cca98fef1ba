"""Data quality: shapes, missing values, duplicates, row counts per stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stopwise.config import TARGET
from stopwise.operators.clean import Bounds, iqr_bounds, keep_positive_target
from stopwise.operators.joins import SkewPlan, row_weights
from stopwise.operators.split import bucket, split_name
from stopwise.sources.tables import Tables


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    missing = F.col(name).isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(name)
    return missing


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def missing_by_column(df: DataFrame, table: str) -> DataFrame:
    """Rows and missing entries of every column, from one aggregate turned on its side."""
    counted = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(is_missing(df, name)).alias(f"missing_{index}") for index, name in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(index).alias("position"),
            F.lit(name).alias("column_name"),
            F.col(f"missing_{index}").alias("missing_count"),
        )
        for index, name in enumerate(df.columns)
    ]
    return counted.select("row_count", F.explode(F.array(entries)).alias("entry")).select(
        F.lit(table).alias("table_name"), "row_count", "entry.position", "entry.column_name", "entry.missing_count"
    )


def data_summary(tables: Tables) -> DataFrame:
    return _stack([missing_by_column(df, name) for name, df in tables.items()])


def missing_values(tables: Tables) -> DataFrame:
    """Columns with missing entries, most first, with their share in percent."""
    return (
        data_summary(tables)
        .filter(F.col("missing_count") > 0)
        .select(
            "table_name",
            "column_name",
            "missing_count",
            (F.col("missing_count") / F.col("row_count") * 100).alias("missing_pct"),
        )
        .orderBy(F.desc("missing_count"), "table_name", "column_name")
    )


def total_missing(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [F.count_if(is_missing(df, name)) for name in df.columns])


def duplicate_count(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each key; null is a key value like any other.

    Keys are counted in two steps, first per key and then over keys, so a hot key
    is one row before it moves.
    """
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
        .select(F.lit(name).alias("table_name"), "duplicates")
    )


def duplicate_counts(tables: Tables) -> DataFrame:
    return _stack(
        [
            duplicate_count(tables.orders, ["web_order_id"], "orders"),
            duplicate_count(tables.service_times, ["web_order_id"], "service_times"),
            duplicate_count(tables.driver_mapping, tables.driver_mapping.columns, "driver_mapping"),
            duplicate_count(tables.articles, ["web_order_id"], "articles"),
        ]
    )


def table_structure(tables: Tables) -> DataFrame:
    """Columns and types of each table with its number of rows."""
    described = []
    for name, df in tables.items():
        entries = [
            F.struct(
                F.lit(index).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
            )
            for index, field in enumerate(df.schema)
        ]
        described.append(
            df.agg(F.count(F.lit(1)).alias("row_count"))
            .select("row_count", F.explode(F.array(entries)).alias("entry"))
            .select(F.lit(name).alias("table_name"), "row_count", "entry.*")
        )
    return _stack(described)


def table_preview(df: DataFrame, order_by: list[str], rows: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order_by).limit(rows)


def nonpositive_targets(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.agg(F.count_if(F.col(target) <= 0).alias("nonpositive"))


def row_funnel(
    tables: Tables,
    null_safe: bool = False,
    skew: SkewPlan = SkewPlan(),
    multiplier: float = 1.5,
    seed: int = 42,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Rows left after each processing stage, from one aggregate over weighted visits."""
    visits = row_weights(tables, null_safe, skew)
    if bounds is None:
        bounds = iqr_bounds(keep_positive_target(visits), TARGET, multiplier, "row_weight")
    value = F.col(TARGET)
    known = value.isNotNull()
    kept = value.between(bounds.lower, bounds.upper) & (value > 0)
    split = split_name(bucket(F.col("web_order_id"), seed))

    def rows(condition: Column, weight: str = "row_weight") -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))

    everything = F.lit(True)
    # Stage names, in order.
    stages = [
        ("start", F.count(F.lit(1))),
        ("orders_joined", rows(everything, "order_weight")),
        ("articles_joined", rows(everything, "order_weight")),
        ("mapping_joined", rows(everything)),
        ("target_known", rows(known)),
        ("target_positive", rows(known & (value > 0))),
        ("outliers_removed", rows(kept)),
        ("train", rows(kept & (split == "train"))),
        ("val", rows(kept & (split == "val"))),
        ("test", rows(kept & (split == "test"))),
    ]
    counted = visits.agg(*[total.alias(name) for name, total in stages])
    entries = [
        F.struct(F.lit(index).alias("stage_no"), F.lit(name).alias("stage"), F.col(name).alias("row_count"))
        for index, (name, _) in enumerate(stages)
    ]
    return counted.select(F.explode(F.array(entries)).alias("entry")).select(
        "entry.*", F.lit(bounds.lower).alias("lower_bound"), F.lit(bounds.upper).alias("upper_bound")
    )
