"""Derived columns and the model's input projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stopwise.config import FEATURES, TARGET


def add_time_features(df: DataFrame) -> DataFrame:
    """Hour, weekday (Monday is 0), month and weekend flag of the order time.

    Text is cast and fails on bad input. An unknown time is no weekend, and its
    other parts stay null.
    """
    if "order_time" not in df.columns:
        return df
    time = F.col("order_time").cast("timestamp_ntz")
    weekday = F.weekday(time)
    return df.withColumns(
        {
            "order_time": time,
            "order_hour": F.hour(time),
            "order_day_of_week": weekday,
            "order_month": F.month(time),
            "is_weekend": F.coalesce((weekday >= 5).cast("int"), F.lit(0)),
        }
    )


def add_interactions(df: DataFrame) -> DataFrame:
    """Weight per box, floor times elevator and business flags, flags as 0/1."""
    elevator, business = F.col("has_elevator").cast("int"), F.col("is_business").cast("int")
    return df.withColumns(
        {
            "weight_per_box": F.when(
                F.col("total_boxes") > 0, F.col("total_weight_g") / F.col("total_boxes")
            ).otherwise(0.0),
            "floor_elevator_interaction": F.col("floor") * elevator,
            "business_floor_interaction": business * F.col("floor"),
            "has_elevator": elevator,
            "is_business": business,
        }
    )


def create_features(df: DataFrame) -> DataFrame:
    return add_interactions(add_time_features(df))


def feature_names(df: DataFrame) -> list[str]:
    return [name for name in FEATURES if name in df.columns]


def feature_matrix(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The existing feature columns in fixed order, with target and any key columns."""
    return df.select(*keys, *feature_names(df), TARGET)
