"""Watching a model in use: versions side by side, later truth, feature drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stopwise.config import FEATURES, TARGET
from stopwise.functions.bins import histogram_bin, magnitude_bin
from stopwise.operators.clean import keep_positive_target
from stopwise.operators.evaluate import add_errors, metrics_by
from stopwise.operators.quantiles import FINE_PER_OCTAVE
from stopwise.operators.skew import HotKeys, lookup_join


def compare_versions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Differences between two versions' predictions for the same requests.

    Batch and position are one join key, so that a large batch is not one task.
    """
    key = F.struct("request_id", "position").alias("key")
    a = first.select(key, F.col("predicted_service_time").alias("first"))
    b = second.select(key, F.col("predicted_service_time").alias("second"))
    gap = F.col("first") - F.col("second")
    return a.join(b, "key").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(gap).alias("mean_difference"),
        F.avg(F.abs(gap)).alias("mean_abs_difference"),
        F.max(F.abs(gap)).alias("max_abs_difference"),
    )


def monitor_accuracy(logs: DataFrame, service_times: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Metrics per model version once the true times are known.

    Several visits of an order count with their mean, so the truth has one row per order.
    """
    truth = keep_positive_target(service_times).filter(F.col("web_order_id").isNotNull())
    truth = truth.groupBy("web_order_id").agg(F.avg(TARGET).alias(TARGET))
    used = logs.select("web_order_id", "model_version", F.col("predicted_service_time").alias("predicted"))
    matched = lookup_join(used.filter(F.col("web_order_id").isNotNull()), truth, "web_order_id", "inner", hot)
    return metrics_by(add_errors(matched), "model_version")


def feature_drift(
    training: DataFrame, recent: DataFrame, names: Sequence[str] = tuple(FEATURES), buckets: int = 10, floor: float = 1e-4
) -> DataFrame:
    """Population stability index of each feature over equal-width bins of the training range.

    Values beyond the range fall into the end bins; an empty bin counts as `floor`.
    """
    spans = training.agg(
        *[F.min(F.col(name).cast("double")).alias(f"low_{i}") for i, name in enumerate(names)],
        *[F.max(F.col(name).cast("double")).alias(f"high_{i}") for i, name in enumerate(names)],
    ).first()

    def bins(df: DataFrame, count: str) -> DataFrame:
        entries = [
            F.struct(
                F.lit(name).alias("feature"),
                F.greatest(
                    histogram_bin(
                        F.col(name).cast("double"),
                        F.lit(spans[f"low_{i}"]).cast("double"),
                        F.lit(spans[f"high_{i}"]).cast("double"),
                        buckets,
                    ),
                    F.lit(0),
                ).alias("bucket"),
                F.col(name).isNotNull().alias("known"),
            )
            for i, name in enumerate(names)
        ]
        placed = df.select(F.explode(F.array(entries)).alias("entry")).select("entry.*").filter("known")
        return placed.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias(count))

    listed = training.sparkSession.createDataFrame(
        [(name, b) for name in names for b in range(buckets)], "feature string, bucket int"
    )
    counts = (
        listed.join(F.broadcast(bins(training, "expected")), ["feature", "bucket"], "left")
        .join(F.broadcast(bins(recent, "seen")), ["feature", "bucket"], "left")
        .fillna(0, ["expected", "seen"])
    )
    totals = counts.groupBy("feature").agg(F.sum("expected").alias("all_expected"), F.sum("seen").alias("all_seen"))
    shares = counts.join(F.broadcast(totals), "feature").select(
        "feature",
        F.greatest(F.try_divide("expected", "all_expected"), F.lit(floor)).alias("p"),
        F.greatest(F.try_divide("seen", "all_seen"), F.lit(floor)).alias("q"),
    )
    return shares.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def distribution_distance(training: DataFrame, recent: DataFrame, names: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each feature, and the smallest value where the gap is widest.

    Both samples become one table of different values with two counts each. Shares up to a value are
    running sums over three levels, coarse bins, fine bins and values, so that no task orders more than
    one bin; equal values of both samples are one row. Unknown values are left out; a
    feature that one sample lacks has no distance.
    """

    def values(df: DataFrame, own: int) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value")) for name in names])
        known = df.select(F.explode(entries).alias("entry")).select("entry.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
        return known.select("feature", "value", F.lit(1 - own).alias("a"), F.lit(own).alias("b"))

    both = values(training, 0).unionByName(values(recent, 1))
    bins = {"coarse": magnitude_bin(F.col("value")), "fine": magnitude_bin(F.col("value"), FINE_PER_OCTAVE)}
    sums = [F.sum("a").alias("a"), F.sum("b").alias("b")]
    counts = both.withColumns(bins).groupBy("feature", "coarse", "fine", "value").agg(*sums)

    def before(rows: DataFrame, part: list[str], order: str) -> DataFrame:
        """Adds how many of each sample lie in earlier rows of the part."""
        window = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(window), F.lit(0)) for c in ("a", "b")})

    coarse = before(counts.groupBy("feature", "coarse").agg(*sums), ["feature"], "coarse")
    totals = coarse.groupBy("feature").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    coarse = coarse.join(F.broadcast(totals), "feature").select("feature", "coarse", F.col("a_before").alias("a_coarse"), F.col("b_before").alias("b_coarse"), "all_a", "all_b")
    fine = before(counts.groupBy("feature", "coarse", "fine").agg(*sums), ["feature", "coarse"], "fine").join(coarse, ["feature", "coarse"])
    fine = fine.select("feature", "fine", *[(F.col(f"{c}_before") + F.col(f"{c}_coarse")).alias(f"{c}_fine") for c in ("a", "b")], "all_a", "all_b")
    placed = before(counts, ["feature", "fine"], "value").join(fine, ["feature", "fine"])
    upto = {c: F.col(f"{c}_fine") + F.col(f"{c}_before") + F.col(c) for c in ("a", "b")}
    gap = F.abs(F.try_divide(upto["a"], F.col("all_a")) - F.try_divide(upto["b"], F.col("all_b")))
    return placed.withColumn("gap", gap).groupBy("feature").agg(
        F.max("gap").alias("distance"), F.max_by("value", F.struct("gap", -F.col("value"))).alias("value"), F.max("all_a").alias("training_count"), F.max("all_b").alias("recent_count")
    )


def as_of(visits: DataFrame, predictions: DataFrame, visit_time: str, hot: HotKeys | None = None) -> DataFrame:
    """Every visit with the order's last prediction at or before it, or nulls: `predicted`, `model_version`, `predicted_at`.

    Both sides become one table, sorted by order and time; the last prediction seen so far is
    carried along. Predictions of an order at the same time count as one, the greatest by
    (value, version); visits at that time see it. A crowded order is cut into time ranges of
    equal length, each sorted on its own; a range starts with what the ranges before it left
    behind, one row for each range. Visits without an order or a time have no prediction;
    predictions without one are nobody's.
    """
    at, answer = F.col("__at"), F.struct(F.col("predicted_service_time").alias("predicted"), "model_version", "__at")
    said = predictions.withColumn("__at", F.col("timestamp")).filter(F.col("web_order_id").isNotNull() & at.isNotNull())
    said = said.groupBy("web_order_id", "__at").agg(F.max(answer).alias("__said"))
    row = F.struct(*visits.columns).alias("__row")
    asked = visits.select("web_order_id", F.col(visit_time).alias("__at"), row)
    able = F.col("web_order_id").isNotNull() & at.isNotNull()
    both = said.select("web_order_id", "__at", "__said", F.lit(None).cast(asked.schema["__row"].dataType).alias("__row")).unionByName(
        asked.filter(able).select("web_order_id", "__at", F.lit(None).cast(said.schema["__said"].dataType).alias("__said"), "__row")
    )
    if hot is None:
        ranged = both.withColumns({"__range": F.lit(0), "__hot": F.lit(False)})
    else:
        edges = both.agg(F.min("__at").alias("low"), F.max("__at").alias("high")).first()
        place = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.lit(edges["low"]).cast("timestamp"))
        length = F.unix_micros(F.lit(edges["high"]).cast("timestamp")) - F.unix_micros(F.lit(edges["low"]).cast("timestamp")) + 1
        marked = hot.mark(both, "__pieces")
        ranged = marked.withColumn("__range", F.coalesce(F.floor(place / (length / F.col("__pieces"))), F.lit(0)).cast("int"))
        ranged = ranged.withColumn("__hot", F.col("__pieces").isNotNull()).drop("__pieces")
    # Order and range are one column, so that no partitioning by the order alone will do.
    part = F.struct("web_order_id", "__range")
    carried = F.last("__said", ignorenulls=True).over(Window.partitionBy(part).orderBy("__at", F.col("__row").isNotNull()))
    matched = ranged.withColumn("__own", carried).filter(F.col("__row").isNotNull())
    if hot is not None:
        crowded = ranged.filter("__hot")
        left = crowded.groupBy("web_order_id", "__range").agg(F.max_by("__said", F.when(F.col("__said").isNotNull(), at)).alias("__left"))
        before = Window.partitionBy("web_order_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        starts = left.select(part.alias("__part"), F.last("__left", ignorenulls=True).over(before).alias("__start"))
        # At most as many rows as crowded orders have ranges, a few times the number of partitions.
        matched = matched.withColumn("__part", part).join(F.broadcast(starts), "__part", "left").withColumn("__own", F.coalesce("__own", "__start"))
    found = matched.select("__row", "__own").unionByName(asked.filter(~able).select("__row", F.lit(None).cast(said.schema["__said"].dataType).alias("__own")))
    return found.select("__row.*", F.col("__own.predicted").alias("predicted"), F.col("__own.model_version").alias("model_version"), F.col("__own.__at").alias("predicted_at"))
