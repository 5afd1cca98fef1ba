"""Histograms, box-plot figures, cumulative distributions, densities, Q-Q points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stopwise.config import TARGET
from stopwise.functions.bins import histogram_bin
from stopwise.functions.normal import inverse_normal
from stopwise.operators.quantiles import exact_quantiles, running_counts

STEP = 4096


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins between smallest and largest value, empty bins included."""
    values = df.select(value.cast("double").alias("value"))
    values = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    span = values.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    low, high = span["low"], span["high"]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower_edge double, upper_edge double, count bigint")
    if low == high:
        # A single value sits in the middle of a range one unit wide.
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    counted = values.groupBy(histogram_bin(F.col("value"), F.lit(low), F.lit(high), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    listed = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return listed.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower_edge"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper_edge"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
    )


def log_histogram(df: DataFrame, column: str = TARGET, bins: int = 50) -> DataFrame:
    """Histogram of log(1 + value) over the positive values."""
    return histogram(df.filter(F.col(column) > 0), F.log1p(column), bins)


def boxplot(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whisker ends and outlier count per group of a fixed list of groups.

    A whisker ends at the outermost value within 1.5 interquartile ranges, never
    inside the box.
    """
    by = list(by)
    values = df.select(*by, F.col(column).cast("double").alias("value"))
    for name in [*by, "value"]:
        values = values.filter(F.col(name).isNotNull())
    quartiles = exact_quantiles(values, "value", [0.25, 0.5, 0.75], by, few_groups=True).select(
        *by, *[F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(["q1", "median", "q3"])]
    )
    if by:
        placed = values.join(F.broadcast(quartiles), by)
    else:
        box = quartiles.first()
        placed = values.withColumns({name: F.lit(box[name] if box else None).cast("double") for name in ["q1", "median", "q3"]})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.least(F.min(F.when(inside, F.col("value"))), F.max("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, F.col("value"))), F.max("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def cumulative_distribution(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value with the share of rows up to and including it."""
    return running_counts(df, column).select(
        "value", "count", "upto", (F.col("upto") / F.col("total")).alias("cumulative")
    )


def density_grid(df: DataFrame, x: str, y: str, cells: int = 50) -> DataFrame:
    """Rows per occupied cell of a square grid over both ranges."""
    span = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in (x, y) for f in (F.min, F.max)]).first()
    cell = [
        histogram_bin(F.col(c), F.lit(span[f"min_{c}"]), F.lit(span[f"max_{c}"]), cells).alias(f"{c}_cell") for c in (x, y)
    ]
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*cell).agg(F.count(F.lit(1)).alias("count"))


def hexagon_density(df: DataFrame, x: str, y: str, across: int = 50) -> DataFrame:
    """Rows per occupied hexagon: `across` hexagons side by side over the range of x, and as many rows as keep them regular.

    The centres form two lattices, the second shifted by half a cell both ways. Of the nearest
    centre in each the nearer one takes the row, the first if both are equally near; halves
    round up. A range of one value counts as one unit wide.
    """
    up = int(across / math.sqrt(3))
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    span = known.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]).first()
    cell = {}
    for c, many in (("x", across), ("y", up)):
        low, high = (span[f"min_{c}"], span[f"max_{c}"]) if span[f"min_{c}"] is not None else (0.0, 1.0)
        cell[c] = low, ((high - low) or 1.0) / many
    at = {c: (F.col(c) - F.lit(low)) / F.lit(width) for c, (low, width) in cell.items()}
    near = {c: F.floor(v + 0.5) for c, v in at.items()}
    shifted = {c: F.floor(v) for c, v in at.items()}
    away = F.pow(at["x"] - near["x"], F.lit(2)) + 3 * F.pow(at["y"] - near["y"], F.lit(2))
    away_shifted = F.pow(at["x"] - shifted["x"] - 0.5, F.lit(2)) + 3 * F.pow(at["y"] - shifted["y"] - 0.5, F.lit(2))
    first = away <= away_shifted
    halves = {c: F.when(first, 2 * near[c]).otherwise(2 * shifted[c] + 1).cast("long").alias(f"{c}_half") for c in ("x", "y")}
    counts = known.select(*halves.values()).groupBy("x_half", "y_half").agg(F.count(F.lit(1)).alias("count"))
    centre = [(F.lit(low) + F.col(f"{c}_half") * F.lit(width / 2)).alias(f"{c}_centre") for c, (low, width) in cell.items()]
    return counts.select("x_half", "y_half", *centre, "count")


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """Every value with its rank and the normal quantile at Filliben's plotting position.

    Equal values share a range of ranks; the range is opened in blocks, so that a
    value held by very many rows never becomes one long list.
    """
    ranked = running_counts(df, column)
    opened = (
        ranked.withColumn("block", F.explode(F.expr(f"sequence(upto - count + 1, upto, {STEP}L)")))
        .withColumn("rank", F.explode(F.expr(f"sequence(block, least(block + {STEP - 1}, upto))")))
    )
    last = F.pow(F.lit(0.5), F.lit(1.0) / F.col("total"))
    position = (
        F.when(F.col("rank") == F.col("total"), last)
        .when(F.col("rank") == 1, 1 - last)
        .otherwise((F.col("rank") - 0.3175) / (F.col("total") + 0.365))
    )
    return opened.select("rank", inverse_normal(position).alias("theoretical"), F.col("value").alias("ordered_value"))


def qq_line(points: DataFrame) -> DataFrame:
    """Least-squares line through the Q-Q points and its correlation."""
    y, x = F.col("ordered_value"), F.col("theoretical")
    return points.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x)).alias("correlation"),
    )
