"""Raw tables to one clean, derived row per delivery."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from stopwise.config import TARGET, Settings
from stopwise.operators.clean import clean_data, impute, iqr_bounds, keep_positive_target
from stopwise.operators.features import create_features, feature_names
from stopwise.operators.joins import SkewPlan, join_datasets, measure_skew, row_weights
from stopwise.sources import tables as store
from stopwise.sources.tables import Tables


def process_tables(
    tables: Tables,
    settings: Settings = Settings(),
    null_safe: bool = False,
    dedupe_mapping: bool = False,
    skew: SkewPlan | None = None,
) -> DataFrame:
    """Join, clean, derive: one lazy plan.

    The target filter is applied to the fact table before any shuffle; left joins
    keep it valid there. The outlier bounds come from the fact table and per-key row
    counts, so the wide join runs once, already filtered.
    """
    tables = replace(tables, service_times=keep_positive_target(tables.service_times))
    skew = skew or measure_skew(tables, null_safe)
    bounds = None
    if settings.remove_outliers:
        weights = row_weights(tables, null_safe, skew, dedupe_mapping)
        bounds = iqr_bounds(weights, TARGET, settings.iqr_multiplier, "row_weight")
    joined = join_datasets(tables, null_safe, skew, dedupe_mapping)
    if settings.missing_strategy != "constant":
        joined = impute(joined, ["floor"], settings.missing_strategy)
    cleaned = clean_data(joined, TARGET, settings.remove_outliers, settings.iqr_multiplier, bounds)
    return create_features(cleaned)


def features_and_target(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """One frame with features and target, so that nothing is matched by position."""
    names = feature_names(df)
    return df.select(*names, TARGET), names


def load_processed(spark: SparkSession, settings: Settings) -> DataFrame:
    """The stored data set, or the whole job from raw tables where none is stored."""
    if store.exists(spark, f"{settings.processed_dir.rstrip('/')}/full_dataset"):
        return store.read_processed(spark, settings.processed_dir)
    return process_tables(store.load_all(spark, settings.raw_dir), settings)
