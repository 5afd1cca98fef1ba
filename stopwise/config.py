"""Defaults for every job, in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass, field

TARGET = "service_time_in_minutes"

# The model's sixteen inputs, in training order.
FEATURES = [
    "floor",
    "has_elevator",
    "is_business",
    "order_hour",
    "order_day_of_week",
    "order_month",
    "is_weekend",
    "total_boxes",
    "total_articles",
    "total_weight_g",
    "avg_article_weight_g",
    "max_article_weight_g",
    "min_article_weight_g",
    "weight_per_box",
    "floor_elevator_interaction",
    "business_floor_interaction",
]

# Per-order article measures.
ARTICLE_MEASURES = [
    "total_boxes",
    "total_articles",
    "total_weight_g",
    "avg_article_weight_g",
    "max_article_weight_g",
    "min_article_weight_g",
]

# Columns of the correlation matrix.
CORRELATED = [
    "service_time_in_minutes",
    "floor",
    "has_elevator",
    "is_business",
    "total_boxes",
    "total_articles",
    "total_weight_g",
    "avg_article_weight_g",
    "order_hour",
    "order_day_of_week",
    "is_weekend",
]

# Labels and edges of the reports.
WEIGHT_CLASSES = ["Sehr Leicht", "Leicht", "Mittel", "Schwer", "Sehr Schwer"]
WEEKDAYS = ["Mo", "Di", "Mi", "Do", "Fr", "Sa", "So"]
TIME_RANGE_EDGES = [0, 5, 10, 15, 20, 25, 30, float("inf")]
TIME_RANGES = ["0-5", "5-10", "10-15", "15-20", "20-25", "25-30", "30+"]
TARGET_QUANTILES = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
ERROR_PERCENTILES = [10, 25, 50, 75, 90, 95, 99]


@dataclass(frozen=True)
class LearnerParams:
    """Tree-ensemble parameters in MLlib's terms.

    L1/L2 penalties and per-tree column sampling do not exist there; a depth of
    5 stands for 31 leaves, because MLlib grows trees level by level.
    """

    trees: int = 100
    depth: int = 5
    learning_rate: float = 0.05
    min_rows_per_leaf: int = 20
    row_share: float = 0.8
    column_share: str = "0.8"
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"
    model_dir: str = "models"
    feature_log: str = "logs/feature_logs"
    prediction_log: str = "logs/prediction_logs"
    model_type: str = "gbt"
    seed: int = 42
    test_size: float = 0.2
    validation_size: float = 0.1
    remove_outliers: bool = True
    iqr_multiplier: float = 1.5
    missing_strategy: str = "constant"
    max_batch_size: int = 100
    max_log_age_days: int = 90
    learner: LearnerParams = field(default_factory=LearnerParams)
