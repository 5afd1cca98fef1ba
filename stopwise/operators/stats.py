"""Descriptive and grouped statistics, counts, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement, product

from pyspark.sql import DataFrame, Row, Window, functions as F, types as T

from stopwise.config import CORRELATED, TARGET, TARGET_QUANTILES, WEIGHT_CLASSES
from stopwise.functions.bins import equal_width_class, histogram_bin
from stopwise.operators.clean import Bounds
from stopwise.operators.profile import total_missing
from stopwise.operators.quantiles import exact_quantiles, grouped_summary


def numeric_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if isinstance(field.dataType, T.NumericType)]


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per entry: column_name, value."""
    entries = [F.struct(F.lit(name).alias("column_name"), F.col(name).cast("double").alias("value")) for name in columns]
    return df.select(*keep, F.explode(F.array(entries)).alias("entry")).select(*keep, "entry.column_name", "entry.value")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles, maximum of each column."""
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    known = {name: F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double")) for name in columns}
    # One aggregate over the rows as they are; its single row is turned on its side.
    wide = df.agg(*[moment(known[name]).alias(f"{key}_{i}") for i, name in enumerate(columns) for key, moment in moments.items()])
    entry = [F.struct(F.lit(name).alias("column_name"), *[F.col(f"{key}_{i}").alias(key) for key in moments]) for i, name in enumerate(columns)]
    basic = wide.select(F.explode(F.array(entry)).alias("entry")).select("entry.*")
    entries = unpivot(df, columns)
    quartiles = exact_quantiles(entries, "value", [0.25, 0.5, 0.75], ["column_name"], few_groups=True)
    return basic.join(F.broadcast(quartiles), "column_name", "left").select(
        "column_name",
        "count",
        "mean",
        "std",
        "min",
        *[F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(["q25", "q50", "q75"])],
        "max",
    )


def quantile_list(df: DataFrame, column: str = TARGET, probabilities: Sequence[float] = tuple(TARGET_QUANTILES)) -> DataFrame:
    entries = [
        F.struct(F.lit(float(q)).alias("probability"), F.get("quantiles", F.lit(i)).alias("value"))
        for i, q in enumerate(probabilities)
    ]
    listed = exact_quantiles(df, column, probabilities)
    return listed.select(F.explode(F.array(entries)).alias("entry")).select("entry.*")


def stats_by(
    df: DataFrame,
    group: str,
    target: str = TARGET,
    min_count: int = 0,
    few_groups: bool = False,
) -> DataFrame:
    """Mean, median and count of the target per group."""
    summary = grouped_summary(df, [group], target, few_groups)
    return summary.filter(F.col("count") >= min_count) if min_count else summary


def mean_by(df: DataFrame, groups: Sequence[str], target: str = TARGET) -> DataFrame:
    kept = df
    for name in groups:
        kept = kept.filter(F.col(name).isNotNull())
    return kept.groupBy(*groups).agg(F.avg(target).alias("mean"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value of these flags occurs, and its share; nulls are left out.

    The counts are a handful of rows, so their totals are a window over them.
    """
    entries = [F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")) for name in columns]
    counted = (
        df.select(F.explode(F.array(entries)).alias("entry"))
        .select("entry.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = F.sum("count").over(Window.partitionBy("column_name"))
    return counted.withColumn("proportion", F.col("count") / total)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), column).limit(k)


def labels_frame(df: DataFrame, labels: Sequence[str], index: str, name: str) -> DataFrame:
    """The full list of labels, so that empty classes show up."""
    rows = [(i, text) for i, text in enumerate(labels)]
    return df.sparkSession.createDataFrame(rows, f"{index} int, {name} string")


def weight_class_stats(df: DataFrame, measure: str = "total_weight_g", target: str = TARGET) -> DataFrame:
    """Mean target in five equal-width weight classes, empty ones included."""
    span = df.agg(F.min(measure).alias("low"), F.max(measure).alias("high")).first()
    index = equal_width_class(F.col(measure), F.lit(span["low"]), F.lit(span["high"]), len(WEIGHT_CLASSES))
    means = df.filter(F.col(measure).isNotNull()).groupBy(index.alias("class_no")).agg(F.avg(target).alias("mean"))
    listed = labels_frame(df, WEIGHT_CLASSES, "class_no", "weight_class")
    return listed.join(F.broadcast(means), "class_no", "left")


def _moments(groups: Sequence[Row], i: int, j: int) -> tuple[float, float, float]:
    """Sums of squares and of products about the mean, over the groups that know both columns."""
    both = [g for g in groups if g["known"][i] == "1" and g["known"][j] == "1"]
    rows = sum(g["n"] for g in both)
    if rows < 2:
        return 0.0, 0.0, 0.0

    def about_mean(product: str, first: int, second: int) -> float:
        sums = [sum(g[f"s{index}"] for g in both) for index in (first, second)]
        return sum(g[product] for g in both) - sums[0] * sums[1] / rows

    def spread(index: int) -> float:
        whole = sum(g[f"p{index}_{index}"] for g in both)
        value = about_mean(f"p{index}_{index}", index, index)
        # Spread within rounding of the squares is none at all.
        return value if value > 1e-12 * whole else 0.0

    return spread(i), spread(j), about_mean(f"p{i}_{j}", i, j)


def correlation_matrix(df: DataFrame, columns: Sequence[str] = tuple(CORRELATED)) -> DataFrame:
    """Pearson correlation of every pair on the rows where both are known.

    Rows are grouped by which columns are known, at most 2^columns groups and a few in
    practice, and each group gives plain sums of values and products, taken about the
    column means for accuracy. The group rows are then merged pair by pair. A constant
    column has no correlation: null, no error.
    """
    names = [name for name in columns if name in df.columns]
    numbers = df.select([F.col(name).cast("double").alias(name) for name in names])
    means = numbers.agg(*[F.avg(name).alias(name) for name in names]).first()
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    known = [F.when(F.col(name).isNotNull(), "1").otherwise("0") for name in names]
    centred = numbers.select(
        F.concat(*known).alias("known"),
        *[F.coalesce(F.col(name) - F.lit(means[name]), F.lit(0.0)).alias(f"x{i}") for i, name in enumerate(names)],
    )
    groups = centred.groupBy("known").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(len(names))],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )
    found = groups.collect()
    moments = {(i, j): _moments(found, i, j) for i, j in pairs}
    rows = []
    for i, j in product(range(len(names)), repeat=2):
        xx, yy, xy = moments[min(i, j), max(i, j)]
        rows.append((names[i], names[j], xy / math.sqrt(xx * yy) if xx > 0 and yy > 0 else None))
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def target_correlations(matrix: DataFrame, target: str = TARGET) -> DataFrame:
    """The target's row of the matrix, strongest positive first."""
    return (
        matrix.filter(F.col("column_a") == target)
        .select(F.col("column_b").alias("feature"), "correlation")
        .orderBy(F.desc_nulls_last("correlation"), "feature")
    )


def top_correlations(matrix: DataFrame, target: str = TARGET, k: int = 10) -> DataFrame:
    """The k strongest correlations by size, with sign."""
    others = target_correlations(matrix, target).filter(F.col("feature") != target).filter(F.col("correlation").isNotNull())
    sign = F.when(F.col("correlation") > 0, "positive").otherwise("negative")
    return others.withColumn("direction", sign).orderBy(F.desc(F.abs("correlation")), "feature").limit(k)


def highest_correlations(matrix: DataFrame, target: str = TARGET, k: int = 5) -> DataFrame:
    """The k highest signed correlations."""
    others = target_correlations(matrix, target).filter(F.col("feature") != target)
    return others.orderBy(F.desc_nulls_last("correlation"), "feature").limit(k)


def bucketed_summary(df: DataFrame, measures: Sequence[str], target: str = TARGET, buckets: int = 20) -> DataFrame:
    """Per measure and equal-width bucket: rows, mean and median of the target.

    Stands for a scatter plot; the ranges of all measures come from one aggregate.
    """
    spans = df.agg(
        *[F.min(F.col(name).cast("double")).alias(f"low_{i}") for i, name in enumerate(measures)],
        *[F.max(F.col(name).cast("double")).alias(f"high_{i}") for i, name in enumerate(measures)],
    ).first()
    entries = [
        F.struct(
            F.lit(name).alias("measure"),
            histogram_bin(
                F.col(name).cast("double"),
                F.lit(spans[f"low_{i}"]).cast("double"),
                F.lit(spans[f"high_{i}"]).cast("double"),
                buckets,
            ).alias("bucket"),
        )
        for i, name in enumerate(measures)
    ]
    placed = df.select(target, F.explode(F.array(entries)).alias("entry")).select(target, "entry.measure", "entry.bucket")
    return grouped_summary(placed.filter(F.col(target).isNotNull()), ["measure", "bucket"], target, few_groups=True)


def eda_summary(df: DataFrame, bounds: Bounds, median: float | None, target: str = TARGET) -> DataFrame:
    """Size, gaps, outliers and the target's main figures, in one aggregate."""
    value = F.col(target)
    outside = (value < F.lit(bounds.lower)) | (value > F.lit(bounds.upper))
    counted = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        total_missing(df).alias("missing_total"),
        F.count_if(outside).alias("outlier_count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return counted.withColumns(
        {"outlier_pct": F.col("outlier_count") / F.col("row_count") * 100, "median": F.lit(median)}
    )
