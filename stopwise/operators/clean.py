"""Cleaning: target rules, fills, interquartile outlier bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stopwise.config import ARTICLE_MEASURES, TARGET
from stopwise.operators.quantiles import exact_quantiles

# What stands in for a missing entry.
DEFAULTS = {"floor": 0.0, "has_elevator": False, "is_business": False, **{name: 0 for name in ARTICLE_MEASURES}}


def keep_positive_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows whose target is known and above zero."""
    value = F.col(target)
    return df.filter(value.isNotNull() & ~F.isnan(value) & (value > 0))


def fill_missing(df: DataFrame) -> DataFrame:
    return df.fillna({name: value for name, value in DEFAULTS.items() if name in df.columns})


@dataclass(frozen=True)
class Bounds:
    q1: float | None
    q3: float | None
    lower: float | None
    upper: float | None


def iqr_bounds(
    df: DataFrame,
    column: str = TARGET,
    multiplier: float = 1.5,
    weight: str | None = None,
) -> Bounds:
    """Quartiles and outlier bounds; four numbers, fetched so that filters on them are literals.

    A literal range reaches the Parquet scan as a pushed filter.
    """
    row = exact_quantiles(df, column, [0.25, 0.75], weight=weight).first()
    if row is None or row["quantiles"][0] is None:
        return Bounds(None, None, None, None)
    q1, q3 = row["quantiles"]
    reach = multiplier * (q3 - q1)
    return Bounds(q1, q3, q1 - reach, q3 + reach)


def remove_outliers(
    df: DataFrame, column: str = TARGET, multiplier: float = 1.5, bounds: Bounds | None = None
) -> DataFrame:
    """Rows within the bounds, both ends included; pass the bounds if they are known."""
    bounds = bounds or iqr_bounds(df, column, multiplier)
    return df.filter(F.col(column).between(bounds.lower, bounds.upper))


def detect_outliers(
    df: DataFrame, column: str = TARGET, multiplier: float = 1.5, bounds: Bounds | None = None
) -> tuple[DataFrame, Bounds]:
    """Rows strictly outside the bounds, and the bounds; nulls are in neither part."""
    bounds = bounds or iqr_bounds(df, column, multiplier)
    outside = (F.col(column) < F.lit(bounds.lower)) | (F.col(column) > F.lit(bounds.upper))
    return df.filter(outside & ~F.isnan(column)), bounds


def clean_data(
    df: DataFrame,
    target: str = TARGET,
    drop_outliers: bool = True,
    multiplier: float = 1.5,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Target rules, fills, then outliers, in this order."""
    cleaned = fill_missing(keep_positive_target(df, target))
    return remove_outliers(cleaned, target, multiplier, bounds) if drop_outliers else cleaned


def impute(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    """Fill numeric columns with their mean, exact median or mode, or drop incomplete rows."""
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy == "constant":
        return fill_missing(df)
    if strategy == "mean":
        fills = df.agg(*[F.avg(name).alias(name) for name in columns])
    elif strategy in ("median", "mode"):
        pairs = F.explode(F.array([F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("value")) for name in columns]))
        longer = df.select(pairs.alias("pair")).select("pair.name", "pair.value").filter(F.col("value").isNotNull())
        if strategy == "median":
            chosen = exact_quantiles(longer, "value", [0.5], ["name"], few_groups=True)
            chosen = chosen.select("name", F.get("quantiles", F.lit(0)).alias("fill"))
        else:
            counted = longer.groupBy("name", "value").count()
            chosen = counted.groupBy("name").agg(F.max_by("value", F.struct("count", -F.col("value"))).alias("fill"))
        fills = chosen.agg(*[F.max(F.when(F.col("name") == name, F.col("fill"))).alias(name) for name in columns])
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    known = {name: value for name, value in fills.first().asDict().items() if value is not None}
    return df.withColumns({name: F.col(name).cast("double") for name in columns}).fillna(known)
