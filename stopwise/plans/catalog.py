"""Every query by name: a function of (session, data folder).

Queries on evaluated, scored or logged rows start from the stored data set, as the
jobs do in production: it is written once per session to the shared folder.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from stopwise.config import CORRELATED, FEATURES, TARGET, WEEKDAYS, LearnerParams, Settings
from stopwise.operators import boosting, clean, distribution, evaluate, features, joins, logs, models, monitoring, profile, scoring, split, stats
from stopwise.operators.articles import aggregate_articles
from stopwise.operators.baseline import RuleModel, cross_validated, fit_rule
from stopwise.operators.quantiles import exact_quantiles
from stopwise.operators.skew import find_hot_keys
from stopwise.plans import training
from stopwise.plans.processing import process_tables
from stopwise.session import scratch_path, tune
from stopwise.sources import artifacts, bucketed, sample_tables, tables as store
from stopwise.sources.schemas import FEATURE_LOGS, PREDICTION_LOGS
from stopwise.sources.tables import Tables
from stopwise.streaming import jobs, windows

Query = Callable[[SparkSession, str], DataFrame]

KEYS = ["web_order_id", "driver_id"]
RULE_VERSION = "rule_1"

_once: dict[tuple, object] = {}


def _remember(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """Statistics and stored tables of a data folder, made once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _once:
        _once[key] = make()
    return _once[key]


def _raw(spark: SparkSession, sf_dir: str) -> Tables:
    tune(spark)
    return sample_tables.tables(spark, sf_dir)


def _skew(spark: SparkSession, sf_dir: str) -> joins.SkewPlan:
    return _remember(spark, sf_dir, "skew", lambda: joins.measure_skew(_raw(spark, sf_dir)))


def _process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_tables(_raw(spark, sf_dir), skew=_skew(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed rows. They are joined and written once, outliers included; the bounds come from the
    stored target, so no join runs for them, and reach every scan as a pushed filter."""

    def write() -> tuple[str, clean.Bounds]:
        path, settings = scratch_path(spark, "processed"), Settings(remove_outliers=False)
        store.write_processed(process_tables(_raw(spark, sf_dir), settings, skew=_skew(spark, sf_dir)), path)
        return path, clean.iqr_bounds(store.read_target(spark, path), multiplier=settings.iqr_multiplier)

    path, bounds = _remember(spark, sf_dir, "processed", write)
    return clean.remove_outliers(store.read_processed(spark, path), bounds=bounds)


def _explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined, uncleaned rows. Many reports read a few of their columns each, so the
    joins run once and the reports scan a columnar table."""

    def write() -> str:
        path = scratch_path(spark, "explore")
        joins.explore_frame(_raw(spark, sf_dir), skew=_skew(spark, sf_dir)).write.parquet(path)
        return path

    return spark.read.parquet(_remember(spark, sf_dir, "explore", write))


def _explore_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_time_features(_explore(spark, sf_dir))


def _rule(spark: SparkSession, sf_dir: str) -> RuleModel:
    parts = split.with_split(_stored(spark, sf_dir))
    return fit_rule(parts.filter(F.col("split") == "train"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule model's predictions for all rows, stored; errors are derived on reading."""

    def write() -> str:
        path = scratch_path(spark, "predictions")
        _rule(spark, sf_dir).transform(split.with_split(_stored(spark, sf_dir))).write.parquet(path)
        return path

    return evaluate.add_errors(spark.read.parquet(_remember(spark, sf_dir, "predictions", write)))


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers that a left join or an unknown time may leave null are given as doubles."""
    names = [n for n in ("total_boxes", "total_articles", "order_hour", "order_day_of_week", "order_month") if n in df.columns]
    df = df.withColumns({name: F.col(name).cast("double") for name in names})
    return _rounded(df, *[name for name in ("avg_article_weight_g", "weight_per_box") if name in df.columns])


# --- sources and quality -------------------------------------------------------


def scan(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return dict(_raw(spark, sf_dir).items())[name]


def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.data_summary(_raw(spark, sf_dir))


def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.missing_values(_raw(spark, sf_dir)), "missing_pct")


def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_counts(_raw(spark, sf_dir))


def table_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_structure(_raw(spark, sf_dir))


def table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_preview(_raw(spark, sf_dir).orders, ["web_order_id"])


PREVIEWS = {
    "articles": ["web_order_id", "article_id", "box_id", "article_weight_in_g"],
    "service_times": ["web_order_id", "driver_id"],
    "driver_mapping": ["web_order_id", "driver_id"],
}


def preview(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_preview(scan(name, spark, sf_dir), PREVIEWS[name])


def nonpositive_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.nonpositive_targets(_raw(spark, sf_dir).service_times)


def row_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.row_funnel(_raw(spark, sf_dir), skew=_skew(spark, sf_dir)), "lower_bound", "upper_bound")


# --- projections and filters ---------------------------------------------------


def clean_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.keep_positive_target(_raw(spark, sf_dir).service_times).select(*KEYS, TARGET)


def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_missing(_explore(spark, sf_dir))
    return _plain(filled.select(*KEYS, *clean.DEFAULTS))


def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _explore_times(spark, sf_dir)
    return _plain(timed.select(*KEYS, "order_time", "order_hour", "order_day_of_week", "order_month", "is_weekend"))


def interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = features.add_interactions(clean.fill_missing(_explore(spark, sf_dir)))
    names = ["weight_per_box", "floor_elevator_interaction", "business_floor_interaction", "has_elevator", "is_business"]
    return _rounded(derived.select(*KEYS, *names), "weight_per_box")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = features.feature_matrix(_process(spark, sf_dir), tuple(KEYS))
    return _plain(matrix)


# --- joins -----------------------------------------------------------------------


def join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_orders(_raw(spark, sf_dir), skew=_skew(spark, sf_dir))


def join_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(joins.join_articles(_raw(spark, sf_dir), skew=_skew(spark, sf_dir)))


def join_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_mapping(_raw(spark, sf_dir), skew=_skew(spark, sf_dir))


def mapping_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = joins.check_mapping(_raw(spark, sf_dir), skew=_skew(spark, sf_dir))
    return checked.groupBy("mapping_check").agg(F.count(F.lit(1)).alias("row_count"))


def join_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(joins.join_datasets(_raw(spark, sf_dir), skew=_skew(spark, sf_dir)))


def _crowded(spark: SparkSession, sf_dir: str) -> Tables:
    tune(spark)
    return sample_tables.crowded(spark, sf_dir)


def join_datasets_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joins with a crowded order, unknown ids and doubled orders, every repeated key cut into pieces."""
    crowded = _crowded(spark, sf_dir)
    skew = joins.measure_skew(crowded, fraction=1.0, min_hits=2, partitions=64)
    return _plain(joins.join_datasets(crowded, skew=skew).select(*KEYS, TARGET, "floor", "total_articles"))


def _bucketed(spark: SparkSession, sf_dir: str, name: str, tables: Tables, **sampling) -> bucketed.Bucketed:
    def write() -> bucketed.Bucketed:
        path = scratch_path(spark, name)
        return bucketed.write(tables, path, f"{name}_{path.rsplit('-', 1)[1]}", **sampling)

    return _remember(spark, sf_dir, name, write)


def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joins on tables stored in buckets."""
    return _plain(bucketed.join(_bucketed(spark, sf_dir, "bucketed", _raw(spark, sf_dir))))


def join_bucketed_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a crowded order, unknown ids and doubled orders."""
    stored = _bucketed(spark, sf_dir, "bucketed_hot", _crowded(spark, sf_dir), fraction=0.5, min_hits=20, partitions=16)
    return _plain(bucketed.join(stored).select(*KEYS, TARGET, "floor", "total_articles"))


def first_per_order_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several differing visits of an order."""
    return scoring.first_per_order(_crowded(spark, sf_dir).service_times)


def duplicate_counts_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_counts(_crowded(spark, sf_dir))


def article_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(aggregate_articles(_raw(spark, sf_dir).articles))


# --- cleaning ----------------------------------------------------------------------


def remove_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = clean.keep_positive_target(_raw(spark, sf_dir).service_times)
    return clean.remove_outliers(visits).select(*KEYS, TARGET)


def detect_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    explored = _explore(spark, sf_dir)
    outside, bounds = clean.detect_outliers(explored)
    counts = explored.agg(F.count(F.lit(1)).alias("row_count")).crossJoin(outside.agg(F.count(F.lit(1)).alias("outlier_count")))
    figures = counts.withColumns(
        {
            "lower_bound": F.lit(bounds.lower),
            "upper_bound": F.lit(bounds.upper),
            "outlier_pct": F.col("outlier_count") / F.col("row_count") * 100,
            "kept_count": F.col("row_count") - F.col("outlier_count"),
        }
    )
    return _rounded(figures, "lower_bound", "upper_bound", "outlier_pct")


def clean_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, skew = _raw(spark, sf_dir), _skew(spark, sf_dir)
    positive = replace(raw, service_times=clean.keep_positive_target(raw.service_times))
    weights = joins.row_weights(positive, skew=skew)
    bounds = clean.iqr_bounds(weights, TARGET, Settings().iqr_multiplier, "row_weight")
    cleaned = clean.clean_data(joins.join_datasets(positive, skew=skew), bounds=bounds)
    return _plain(cleaned)


def create_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = features.create_features(clean.fill_missing(_explore(spark, sf_dir)))
    return _plain(derived)


def processed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_process(spark, sf_dir))


def load_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed rows as written to their sink and read back."""
    return _plain(_stored(spark, sf_dir))


def load_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of the stored rows."""
    return _stored(spark, sf_dir).select(TARGET)


def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.impute(_explore(spark, sf_dir).select(*KEYS, "floor"), ["floor"], "median")
    return _rounded(filled, "floor")


# --- statistics ----------------------------------------------------------------------


def describe_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stats.describe(_raw(spark, sf_dir).service_times, [TARGET])
    return _rounded(described, "mean", "std", "q25", "q50", "q75")


def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _explore(spark, sf_dir)
    described = stats.describe(joined, stats.numeric_columns(joined))
    return _rounded(described, "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stats.describe(_stored(spark, sf_dir), [*FEATURES, TARGET])
    return _rounded(described, "mean", "std", "min", "q25", "q50", "q75", "max")


def target_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.quantile_list(_raw(spark, sf_dir).service_times), "value")


def _grouped(df: DataFrame, group: str, **options) -> DataFrame:
    return _rounded(stats.stats_by(df, group, **options), "mean", "median")


def stats_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _explore_times(spark, sf_dir)
    return _grouped(timed, "order_hour", few_groups=True)


def stats_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _explore_times(spark, sf_dir)
    summary = _grouped(timed, "order_day_of_week", few_groups=True)
    return summary.withColumn("weekday", stats_label("order_day_of_week"))


def stats_label(index: str):
    return F.get(F.array([F.lit(day) for day in WEEKDAYS]), F.col(index))


def stats_by_elevator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(_explore(spark, sf_dir), "has_elevator", few_groups=True)


def stats_by_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(_explore(spark, sf_dir), "is_business", few_groups=True)


def stats_by_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(_explore(spark, sf_dir), "floor", min_count=10)


def floor_elevator_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.mean_by(_explore(spark, sf_dir), ["has_elevator", "floor"]), "mean")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.value_counts(_explore(spark, sf_dir), ["has_elevator", "is_business"]), "proportion")


def top_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_values(_explore(spark, sf_dir), "floor")


def weight_class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.weight_class_stats(_explore(spark, sf_dir)), "mean")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation_matrix(_explore_times(spark, sf_dir), CORRELATED)


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_matrix(spark, sf_dir), "correlation")


def target_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.target_correlations(_matrix(spark, sf_dir)), "correlation")


def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.top_correlations(_matrix(spark, sf_dir)), "correlation")


def top5_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.highest_correlations(_matrix(spark, sf_dir)), "correlation")


def target_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["total_weight_g", "total_boxes", "total_articles"]
    return _rounded(stats.bucketed_summary(_explore(spark, sf_dir), measures), "mean", "median")


def eda_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q1, median, q3 = exact_quantiles(_explore(spark, sf_dir), TARGET, [0.25, 0.5, 0.75]).first()["quantiles"]
    bounds = clean.Bounds(q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    summary = stats.eda_summary(_explore_times(spark, sf_dir), bounds, median)
    return _rounded(summary, "mean", "std", "outlier_pct", "median")


# --- distributions --------------------------------------------------------------------


def _edges(df: DataFrame) -> DataFrame:
    return _rounded(df, "lower_edge", "upper_edge")


def target_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(distribution.histogram(_raw(spark, sf_dir).service_times, F.col(TARGET)))


def log_target_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(distribution.log_histogram(_raw(spark, sf_dir).service_times))


def inlier_target_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.remove_outliers(_raw(spark, sf_dir).service_times)
    return _edges(distribution.histogram(kept, F.col(TARGET)))


def residual_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(distribution.histogram(_errors(spark, sf_dir), F.col("residual")))


def boxplot_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = distribution.boxplot(_raw(spark, sf_dir).service_times, TARGET)
    return _rounded(figures, "q1", "median", "q3", "whisker_low", "whisker_high")


def boxplot_error_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = evaluate.error_boxplot_by_range(_errors(spark, sf_dir))
    return _rounded(figures, "q1", "median", "q3", "whisker_low", "whisker_high")


def target_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(distribution.cumulative_distribution(_raw(spark, sf_dir).service_times, TARGET), "cumulative", digits=8)


def error_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows with at most this absolute error."""
    shares = distribution.cumulative_distribution(_errors(spark, sf_dir), "abs_error")
    return _rounded(shares.withColumn("cumulative", F.col("cumulative") * 100), "value", "cumulative")


def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.density_grid(_errors(spark, sf_dir), TARGET, "predicted")


def hexagon_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(distribution.hexagon_density(_errors(spark, sf_dir), TARGET, "predicted"), "x_centre", "y_centre")


def _qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.qq_points(_errors(spark, sf_dir), "residual")


def qq_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_qq(spark, sf_dir), "theoretical", "ordered_value")


def qq_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(distribution.qq_line(_qq(spark, sf_dir)), "slope", "intercept", "correlation")


# --- split, evaluation ---------------------------------------------------------------


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(_stored(spark, sf_dir))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part each stored row belongs to."""
    return split.with_split(_stored(spark, sf_dir)).select(*KEYS, "split")


def sample_5pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.exact_sample(_stored(spark, sf_dir).select(*KEYS, TARGET))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _errors(spark, sf_dir).select(*KEYS, "split", TARGET, "predicted", "residual", "abs_error")
    return _rounded(chosen, "predicted", "residual", "abs_error")


def _by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics_by(_errors(spark, sf_dir), "split")


def evaluate_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_by_split(spark, sf_dir), "rmse", "mae", "r2")


def combined_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = evaluate.combined_metrics(_by_split(spark, sf_dir))
    names = [f"{part}_{metric}" for part in ("train", "val", "test") for metric in ("rmse", "mae", "r2")]
    return whole.select([F.round(F.col("metrics")[name], 4).alias(name) for name in names])


def cross_validate_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the rule on each fold when fitted on the others."""
    checked = evaluate.add_errors(cross_validated(_stored(spark, sf_dir)))
    return _rounded(evaluate.metrics_by(checked, "fold"), "rmse", "mae", "r2")


def model_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _by_split(spark, sf_dir).select("split", "r2", evaluate.rating(F.col("r2")).alias("rating"))
    return _rounded(rated, "r2")


def mae_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.errors_by_range(_errors(spark, sf_dir)).select("range_no", "time_range", "mae"), "mae")


def count_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors_by_range(_errors(spark, sf_dir)).select("range_no", "time_range", "row_count")


def r2_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.errors_by_range(_errors(spark, sf_dir)).select("range_no", "time_range", "r2"), "r2")


def feature_vs_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluate.error_by_feature(_errors(spark, sf_dir), FEATURES)
    return _rounded(table, "mean_abs_error", "overall_mae")


def residuals_by_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluate.residuals_by_prediction(_errors(spark, sf_dir))
    return _rounded(table, "mean_residual", "std_residual", "mean_abs_error")


def error_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.error_percentiles(_errors(spark, sf_dir)), "abs_error")


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluate.evaluation_summary(_errors(spark, sf_dir))
    return _rounded(summary, "rmse", "mae", "r2", "max_error", "median_error", "p90_error")


# --- scoring ---------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return sample_tables.requests(spark, sf_dir)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup table, stored: every scoring job joins it, none builds it."""

    def write() -> str:
        path = scratch_path(spark, "feature_table")
        store.write_lookup(scoring.feature_table(_stored(spark, sf_dir)), path, "web_order_id")
        return path

    return spark.read.parquet(_remember(spark, sf_dir, "feature table", write))


WANTED = [str(i) for i in range(0, 15000, 331)]  # a request's orders; some are unknown


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the orders of one request, found by range and Bloom filter."""
    return _plain(_features(spark, sf_dir).filter(F.col("web_order_id").isin(WANTED)))


def _hot_requests(spark: SparkSession, sf_dir: str, column: str):
    find = partial(find_hot_keys, _requests(spark, sf_dir), [column])
    return _remember(spark, sf_dir, f"hot requests {column}", find)


def first_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = scoring.first_per_order(_stored(spark, sf_dir).select("web_order_id", "order_datetime", "driver_id", TARGET, "floor"))
    return chosen.select("web_order_id", "driver_id", "order_datetime", TARGET, "floor")


def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.extract_features(
        _requests(spark, sf_dir), _features(spark, sf_dir), _hot_requests(spark, sf_dir, "web_order_id")
    )
    names = ["request_id", "position", "driver_id", "web_order_id", *FEATURES]
    return _plain(found.select(names))


def lookup_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = scoring.unknown_orders(
        _requests(spark, sf_dir), _features(spark, sf_dir), _hot_requests(spark, sf_dir, "web_order_id")
    )
    return rejected.select("request_id", "position", "driver_id", "web_order_id")


def _rule_model(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """The rule model on looked-up features, where flags are doubles."""
    rule = _rule(spark, sf_dir)
    rule = replace(rule, cells=rule.cells.withColumn("has_elevator", F.col("has_elevator").cast("double")))
    return rule.transform


def _score(spark: SparkSession, sf_dir: str, model=None, version: str = RULE_VERSION) -> DataFrame:
    return scoring.score(
        _requests(spark, sf_dir),
        _features(spark, sf_dir),
        model or _rule_model(spark, sf_dir),
        version,
        _hot_requests(spark, sf_dir, "web_order_id"),
    )


SCORED = ["request_id", "position", "driver_id", "web_order_id", "predicted_service_time", "model_version"]


def score_batch_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_score(spark, sf_dir).select(SCORED), "predicted_service_time")


def batch_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and verdict of every batch, with its predictions, in 1/10000 minutes, page by page."""
    requests = _requests(spark, sf_dir)
    hot = _hot_requests(spark, sf_dir, "web_order_id")
    found = scoring.extract_features(requests, _features(spark, sf_dir).select("web_order_id"), hot)
    status = scoring.batch_status(requests, found)
    answers = scoring.response_pages(_score(spark, sf_dir))  # `known` is the total of a batch
    entry = lambda p: F.concat_ws(":", p["position"], p["web_order_id"], F.round(p["predicted_service_time"] * 10000).cast("long"))
    pages = answers.select(
        "request_id",
        F.col("page").cast("double").alias("page"),
        F.array_join(F.transform("predictions", entry), ",").alias("predictions"),
        F.col("total_count").cast("double").alias("total_count"),
        "timestamp",
    )
    return status.join(pages, "request_id", "left")


# --- logs and monitoring -----------------------------------------------------------------


def _written_logs(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Both logs of the scored requests, written once."""

    def write() -> tuple[str, str]:
        paths = scratch_path(spark, "feature_logs"), scratch_path(spark, "prediction_logs")
        logs.append_scored(_score(spark, sf_dir), *paths, "first")
        return paths

    return _remember(spark, sf_dir, "logs", write)


def feature_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = logs.read(spark, _written_logs(spark, sf_dir)[0], FEATURE_LOGS)
    parsed = logs.parse_features(entries).select("id", "timestamp", "web_order_id", "driver_id", "model_version", *FEATURES)
    return _plain(parsed)


def prediction_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = logs.read(spark, _written_logs(spark, sf_dir)[1], PREDICTION_LOGS)
    return _rounded(entries.drop("run_id"), "predicted_service_time")


def _indexed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write() -> str:
        path = scratch_path(spark, "indexed_log")
        logs.append(sample_tables.prediction_logs(tune(spark), sf_dir).withColumn("id", F.col("id").cast("string")), path, "first")
        return path

    return logs.read(spark, _remember(spark, sf_dir, "indexed log", write), PREDICTION_LOGS)


def log_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logged predictions of a request's orders."""
    return logs.of_orders(_indexed_log(spark, sf_dir), WANTED).drop("log_date", "run_id")


def get_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = logs.read(spark, _written_logs(spark, sf_dir)[0], FEATURE_LOGS)
    return logs.newest(entries, driver_id="D7").select("id", "timestamp", "web_order_id", "driver_id", "model_version")


def get_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return logs.newest(sample_tables.prediction_logs(spark, sf_dir), driver_id="D3", limit=100)


def prediction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return _rounded(logs.statistics(sample_tables.prediction_logs(spark, sf_dir)), "avg_prediction")


def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = logs.read(spark, _written_logs(spark, sf_dir)[1], PREDICTION_LOGS)
    kept = logs.retained(entries, "2024-01-31", 14)
    return kept.groupBy("log_date").agg(F.count(F.lit(1)).alias("row_count"))


def compare_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split.with_split(_stored(spark, sf_dir))
    simple = fit_rule(parts.filter(F.col("split") == "train"), ["floor"])
    compared = monitoring.compare_versions(_score(spark, sf_dir), _score(spark, sf_dir, simple.transform, "rule_2"))
    return _rounded(compared, "mean_difference", "mean_abs_difference", "max_abs_difference")


def monitor_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = sample_tables.prediction_logs(tune(spark), sf_dir)
    hot = _remember(spark, sf_dir, "hot logs", lambda: find_hot_keys(entries, ["web_order_id"]))
    accuracy = monitoring.monitor_accuracy(entries, _raw(spark, sf_dir).service_times, hot)
    return _rounded(accuracy, "rmse", "mae", "r2")


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, visits = sample_tables.prediction_logs(tune(spark), sf_dir), sample_tables.timed_visits(spark, sf_dir)
    hot = _remember(spark, sf_dir, "hot visits", lambda: find_hot_keys(visits, ["web_order_id"], fraction=0.1))
    return monitoring.as_of(visits, entries, "visited_at", hot)


def predictions_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visit with the prediction that stood when it began."""
    return _as_of(spark, sf_dir)


def accuracy_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per model version against the truth of the visits its predictions stood for."""
    matched = clean.keep_positive_target(_as_of(spark, sf_dir)).filter(F.col("predicted").isNotNull())
    return _rounded(evaluate.metrics_by(evaluate.add_errors(matched), "model_version"), "rmse", "mae", "r2")


def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = logs.read(spark, _written_logs(spark, sf_dir)[0], FEATURE_LOGS)
    return _rounded(monitoring.feature_drift(_stored(spark, sf_dir), logs.parse_features(entries)), "psi")


def feature_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the logged features have moved from those trained on, without bins."""
    entries = logs.parse_features(logs.read(spark, _written_logs(spark, sf_dir)[0], FEATURE_LOGS))
    return _rounded(monitoring.distribution_distance(_stored(spark, sf_dir), entries), "distance", "value", digits=6)


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule model's run: recorded, read back, metrics split by part."""

    def write() -> str:
        path = scratch_path(spark, "rule_runs")
        metrics, samples = training.evaluate(_errors(spark, sf_dir))
        at = datetime.datetime(2024, 1, 31)
        artifacts.write_run(spark, path, RULE_VERSION, "rule", at, ["floor", "has_elevator"], metrics, {}, samples)
        return path

    path = _remember(spark, sf_dir, "rule run", write)
    row = artifacts.model_metrics(spark, path)
    names = ("rmse", "mae", "r2")
    return row.select(
        "model_version",
        "model_type",
        *[F.round(F.col("training_metrics")[name], 4).alias(f"training_{name}") for name in names],
        *[F.round(F.col("test_metrics")[name], 4).alias(f"testing_{name}") for name in names],
    )


# --- trained models ------------------------------------------------------------------------


def _settings(spark: SparkSession, sf_dir: str) -> Settings:
    def make() -> Settings:
        return Settings(
            model_dir=scratch_path(spark, "models"),
        )

    return _remember(spark, sf_dir, "settings", make)


def _trained(spark: SparkSession, sf_dir: str) -> training.Trained:
    def make() -> training.Trained:
        stored = _stored(spark, sf_dir)
        return training.train(spark, _settings(spark, sf_dir), prepared=(split.with_split(stored), features.feature_names(stored)))

    return _remember(spark, sf_dir, "trained", make)


def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = _trained(spark, sf_dir)
    data = split.with_split(_stored(spark, sf_dir))
    return evaluate.metrics_by(evaluate.add_errors(models.predict(data, trained.model)), "split")


LEAFWISE = boosting.LeafwiseParams(trees=12, learning_rate=0.3, depth=5, leaves=16)


def _leafwise(spark: SparkSession, sf_dir: str) -> boosting.Boosted:
    def make() -> boosting.Boosted:
        parts = split.with_split(_stored(spark, sf_dir))
        return boosting.fit(parts.filter(F.col("split") == "train"), params=LEAFWISE)

    return _remember(spark, sf_dir, "leafwise", make)


def train_leafwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the penalised, leaf-wise grown trees by part."""
    data = split.with_split(_stored(spark, sf_dir))
    return evaluate.metrics_by(evaluate.add_errors(_leafwise(spark, sf_dir).predict(data)), "split")


def split_counts_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often those trees split on each feature, and what it gained."""
    return boosting.importance(_leafwise(spark, sf_dir).nodes(spark))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response for a batch with its own total, whatever the number of its pages."""
    answers = scoring.batch_responses(_score(spark, sf_dir))
    return answers.groupBy("request_id").agg(F.max("batch_count").alias("total_count"), F.count(F.lit(1)).alias("pages"), F.sum(F.size("predictions")).alias("listed"), F.max("timestamp").alias("timestamp"))


def train_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = split.with_split(_stored(spark, sf_dir))
    pipeline = models.create_model("random_forest", LearnerParams())
    model = models.fit(data.filter(F.col("split") == "train"), pipeline)
    return evaluate.metrics_by(evaluate.add_errors(models.predict(data, model)), "split")


def cross_validate_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error over the folds for each depth of a small ensemble."""
    depths = (2, 4)
    found = models.cross_validate(_stored(spark, sf_dir), params=LearnerParams(trees=5), depths=depths)
    return spark.createDataFrame(list(zip(depths, map(float, found.avgMetrics))), "depth int, rmse double")


def top_feature_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by the six features that the trained model ranks first."""
    ranked = feature_importance(spark, sf_dir).orderBy(F.desc("importance"), "feature").limit(6).collect()
    return evaluate.error_by_feature(_errors(spark, sf_dir), [row["feature"] for row in ranked])


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _trained(spark, sf_dir)
    return artifacts.read_importance(spark, _settings(spark, sf_dir).model_dir)


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _trained(spark, sf_dir)
    return artifacts.model_metrics(spark, _settings(spark, sf_dir).model_dir)


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _trained(spark, sf_dir)
    return artifacts.list_models(spark, _settings(spark, sf_dir).model_dir)


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _trained(spark, sf_dir)
    model = artifacts.load_model(spark, _settings(spark, sf_dir).model_dir)
    return _score(spark, sf_dir, lambda df: models.predict(df, model), "latest").select(SCORED)


# --- streams ----------------------------------------------------------------------------------


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request files scored as a stream; the prediction log it leaves."""

    def run() -> str:
        incoming = scratch_path(spark, "requests")
        _requests(spark, sf_dir).repartition(4, "position").write.parquet(incoming)
        log = scratch_path(spark, "stream_predictions")
        query = jobs.score_stream(
            jobs.read_requests(spark, incoming, files_per_batch=2),
            _features(spark, sf_dir),
            _rule_model(spark, sf_dir),
            scratch_path(spark, "stream_features"),
            log,
            scratch_path(spark, "stream_checkpoint"),
            RULE_VERSION,
        )
        query.awaitTermination()
        return log

    entries = logs.read(spark, _remember(spark, sf_dir, "stream scores", run), PREDICTION_LOGS)
    return _rounded(entries.drop("run_id", "log_date"), "predicted_service_time")


def stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly statistics of the prediction log, computed as a stream."""

    def run() -> str:
        entries = sample_tables.prediction_logs(tune(spark), sf_dir)
        log = scratch_path(spark, "stream_log")
        logs.append(entries.withColumn("id", F.col("id").cast("string")), log, "first")
        path = scratch_path(spark, "stream_statistics")
        incoming = jobs.read_predictions(spark, log, files_per_batch=20)
        jobs.write_statistics(incoming, path, scratch_path(spark, "statistics_checkpoint")).awaitTermination()
        return path

    found = jobs.hourly_statistics(spark, _remember(spark, sf_dir, "stream statistics", run))
    found = found.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")})
    return _rounded(found, "avg_prediction", digits=8)


DELIVERIES = 4


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction log as it comes in: eight days at a time, every tenth row one delivery late, so out of order."""
    entries = sample_tables.prediction_logs(tune(spark), sf_dir).withColumn("id", F.col("id").cast("string"))
    tardy = (F.col("id").cast("long") % 10 == 0).cast("int")
    return entries.withColumn("delivery", F.least(F.lit(DELIVERIES - 1), F.floor((F.dayofmonth("timestamp") - 1) / 8) + tardy))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly statistics from the state store, with the rows that came after their window had closed."""

    def run() -> windows.Places:
        places, log = windows.Places(scratch_path(spark, "windows")), scratch_path(spark, "delivered_log")
        for number in range(DELIVERIES):
            logs.append(_deliveries(spark, sf_dir).filter(F.col("delivery") == number).drop("delivery"), log, f"delivery-{number}")
            windows.run(jobs.read_predictions(spark, log, files_per_batch=1_000_000), places)
        return places

    found = windows.windows(spark, _remember(spark, sf_dir, "stream windows", run))
    found = found.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")})
    return _rounded(found, "avg_prediction", digits=8)


def all_queries() -> dict[str, Query]:
    plain = [
        data_summary, missing_values, duplicate_counts, table_structure, table_preview, nonpositive_targets, row_funnel,
        clean_target, fill_missing, time_features, interaction_features, feature_matrix,
        join_orders, join_articles, join_mapping, mapping_check, join_datasets, join_datasets_hot, join_bucketed, join_bucketed_hot, duplicate_counts_hot,
        remove_outliers, detect_outliers, clean_data, create_features, processed_dataset, load_processed, load_target, impute_median,
        describe_target, describe_numeric, describe_features, target_quantiles,
        stats_by_hour, stats_by_weekday, stats_by_elevator, stats_by_business, stats_by_floor,
        floor_elevator_mean, value_counts, top_floors, weight_class_stats,
        correlation_matrix, target_correlations, top_correlations, top5_correlations, target_by_measure, eda_summary,
        target_hist, log_target_hist, inlier_target_hist, residual_hist, boxplot_target, boxplot_error_by_range,
        target_ecdf, error_ecdf, density_grid, hexagon_density, qq_residuals, qq_line,
        split_counts, split_rows, sample_5pct, residuals, evaluate_by_split, combined_metrics, cross_validate_rule, model_rating,
        mae_by_range, count_by_range, r2_by_range, feature_vs_error, residuals_by_prediction,
        error_percentiles, evaluation_summary,
        first_per_order, first_per_order_hot, feature_lookup, order_features, lookup_rejects, score_batch_rule, batch_response, batch_totals,
        feature_log_rows, prediction_log_rows, log_of_orders, get_features, get_predictions, prediction_statistics,
        log_retention, compare_versions, monitor_accuracy, predictions_as_of, accuracy_as_of, feature_drift, feature_distance, run_metrics,
        train_gbt, train_leafwise, split_counts_by_feature, train_rf, cross_validate_trees, feature_importance, top_feature_errors, model_metrics, model_registry, score_batch,
        stream_scores, stream_statistics, stream_windows,
    ]
    named: dict[str, Query] = {
        "scan_orders": partial(scan, "orders"),
        "scan_articles": partial(scan, "articles"),
        "scan_service_times": partial(scan, "service_times"),
        "scan_driver_mapping": partial(scan, "driver_mapping"),
        "aggregate_articles": article_totals,
        **{f"preview_{name}": partial(preview, name) for name in PREVIEWS},
    }
    return named | {query.__name__: query for query in plain}
