"""Prediction errors: overall, per part, per range, per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stopwise.config import ERROR_PERCENTILES, TARGET, TIME_RANGE_EDGES, TIME_RANGES
from stopwise.functions.bins import half_open_bin, histogram_bin
from stopwise.operators.distribution import boxplot
from stopwise.operators.quantiles import exact_quantiles
from stopwise.operators.stats import labels_frame


def add_errors(df: DataFrame, actual: str = TARGET, predicted: str = "predicted") -> DataFrame:
    """Residual (actual minus predicted) and its absolute value."""
    residual = F.col(actual) - F.col(predicted)
    return df.withColumns({"residual": residual, "abs_error": F.abs(residual)})


def rmse() -> Column:
    return F.sqrt(F.avg(F.col("residual") * F.col("residual")))


def mae() -> Column:
    return F.avg("abs_error")


def r_squared(actual: str = TARGET) -> Column:
    """Share of variance explained; for a constant actual 1 without error, else 0."""
    errors = F.sum(F.col("residual") * F.col("residual"))
    spread = F.var_pop(actual) * F.count(F.lit(1))
    constant = F.when(errors == 0, 1.0).otherwise(0.0)
    return F.when(F.count(F.lit(1)) == 0, None).when(spread == 0, constant).otherwise(1 - F.try_divide(errors, spread))


def rating(r2: Column) -> Column:
    return F.when(r2 > 0.8, "EXCELLENT").when(r2 > 0.6, "GOOD").when(r2 > 0.4, "FAIR").otherwise("POOR")


def metrics_by(df: DataFrame, group: str, actual: str = TARGET) -> DataFrame:
    """RMSE, MAE and R² of each group in one aggregate; expects the error columns."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("row_count"), rmse().alias("rmse"), mae().alias("mae"), r_squared(actual).alias("r2")
    )


def combined_metrics(by_split: DataFrame) -> DataFrame:
    """One row with a map such as test_rmse -> value over all parts; at most nine entries."""
    entries = F.array(
        *[F.struct(F.concat("split", F.lit(f"_{name}")).alias("key"), F.col(name).alias("value")) for name in ["rmse", "mae", "r2"]]
    )
    exploded = by_split.select(F.explode(entries).alias("entry"))
    return exploded.agg(F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("metrics"))


def time_range(actual: str = TARGET) -> Column:
    return half_open_bin(F.col(actual), TIME_RANGE_EDGES)


def errors_by_range(df: DataFrame, actual: str = TARGET) -> DataFrame:
    """Count, MAE and R² per range of the actual value, empty ranges included."""
    placed = df.withColumn("range_no", time_range(actual)).filter(F.col("range_no").isNotNull())
    found = placed.groupBy("range_no").agg(
        F.count(F.lit(1)).alias("n"), mae().alias("mae"), r_squared(actual).alias("r2")
    )
    listed = labels_frame(df, TIME_RANGES, "range_no", "time_range")
    return listed.join(F.broadcast(found), "range_no", "left").select(
        "range_no",
        "time_range",
        F.coalesce("n", F.lit(0)).alias("row_count"),
        "mae",
        F.when(F.coalesce("n", F.lit(0)) <= 1, 0.0).otherwise(F.col("r2")).alias("r2"),
    )


def error_boxplot_by_range(df: DataFrame, actual: str = TARGET) -> DataFrame:
    figures = boxplot(df.withColumn("range_no", time_range(actual)), "abs_error", ["range_no"])
    listed = labels_frame(df, TIME_RANGES, "range_no", "time_range")
    return listed.join(F.broadcast(figures), "range_no", "left").fillna(0, ["count", "outliers"])


def error_percentiles(df: DataFrame, percentiles: Sequence[int] = tuple(ERROR_PERCENTILES)) -> DataFrame:
    entries = [
        F.struct(F.lit(p).alias("percentile"), F.get("quantiles", F.lit(i)).alias("abs_error"))
        for i, p in enumerate(percentiles)
    ]
    listed = exact_quantiles(df, "abs_error", [p / 100 for p in percentiles])
    return listed.select(F.explode(F.array(entries)).alias("entry")).select("entry.*")


def residuals_by_prediction(df: DataFrame, predicted: str = "predicted", buckets: int = 20) -> DataFrame:
    """Per bucket of predictions: count, mean and deviation of residuals, mean absolute error."""
    span = df.agg(F.min(predicted).alias("low"), F.max(predicted).alias("high")).first()
    index = histogram_bin(F.col(predicted), F.lit(span["low"]), F.lit(span["high"]), buckets)
    return df.groupBy(index.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("residual").alias("mean_residual"),
        F.stddev_samp("residual").alias("std_residual"),
        F.avg("abs_error").alias("mean_abs_error"),
    )


def error_by_feature(df: DataFrame, features: Sequence[str], buckets: int = 20) -> DataFrame:
    """Per feature and equal-width bucket: count and mean absolute error; overall MAE alongside."""
    numbers = [F.col(name).cast("double") for name in features]
    spans = df.agg(
        *[F.min(number).alias(f"low_{i}") for i, number in enumerate(numbers)],
        *[F.max(number).alias(f"high_{i}") for i, number in enumerate(numbers)],
        mae().alias("overall_mae"),
    ).first()
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            histogram_bin(number, F.lit(spans[f"low_{i}"]), F.lit(spans[f"high_{i}"]), buckets).alias("bucket"),
        )
        for i, (name, number) in enumerate(zip(features, numbers))
    ]
    placed = df.select("abs_error", F.explode(F.array(entries)).alias("entry")).select("abs_error", "entry.*")
    return (
        placed.filter(F.col("bucket").isNotNull())
        .groupBy("feature", "bucket")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("abs_error").alias("mean_abs_error"))
        .withColumn("overall_mae", F.lit(spans["overall_mae"]))
    )


def evaluation_summary(df: DataFrame, actual: str = TARGET) -> DataFrame:
    """Metrics, error spread and the verdict, in one row."""
    spread = exact_quantiles(df, "abs_error", [0.5, 0.9]).first()
    median, ninetieth = spread["quantiles"] if spread else (None, None)
    figures = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        rmse().alias("rmse"),
        mae().alias("mae"),
        r_squared(actual).alias("r2"),
        F.max("abs_error").alias("max_error"),
    )
    return figures.withColumns(
        {
            "median_error": F.lit(median).cast("double"),
            "p90_error": F.lit(ninetieth).cast("double"),
            "rating": rating(F.col("r2")),
        }
    )
