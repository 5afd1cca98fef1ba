"""Declared schemas of every table the jobs read or write."""

from __future__ import annotations

from pyspark.sql import types as T

from stopwise.config import FEATURES


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _double, _flag, _time = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()

ORDERS = _struct(
    web_order_id=_text,
    customer_id=_text,
    warehouse_id=_text,
    order_time=_time,
    floor=_double,
    has_elevator=_flag,
    is_business=_flag,
)

ARTICLES = _struct(
    web_order_id=_text,
    warehouse_id=_text,
    box_id=_text,
    article_id=_text,
    article_weight_in_g=_double,
)

SERVICE_TIMES = _struct(
    web_order_id=_text,
    driver_id=_text,
    customer_id=_text,
    trip_id=_text,
    order_datetime=_time,
    service_time_start=_time,
    service_time_end=_time,
    service_time_in_minutes=_double,
)

DRIVER_MAPPING = _struct(driver_id=_text, web_order_id=_text)

REQUESTS = _struct(request_id=_text, position=T.LongType(), driver_id=_text, web_order_id=_text, requested_at=_time)

FEATURE_VECTOR = T.StructType([T.StructField(name, _double) for name in FEATURES])

FEATURE_LOGS = _struct(
    id=_text,
    timestamp=_time,
    web_order_id=_text,
    driver_id=_text,
    features=_text,
    model_version=_text,
    log_date=T.DateType(),
    run_id=T.StringType(),
)

PREDICTION_LOGS = _struct(
    id=_text,
    timestamp=_time,
    web_order_id=_text,
    driver_id=_text,
    predicted_service_time=_double,
    model_version=_text,
    request_id=_text,
    log_date=T.DateType(),
    run_id=T.StringType(),
)

RUNS = T.StructType(
    [
        T.StructField("version", _text),
        T.StructField("model_type", _text),
        T.StructField("timestamp", _time),
        T.StructField("model_path", _text),
        T.StructField("feature_names", T.ArrayType(_text)),
        T.StructField("metrics", T.MapType(_text, _double)),
        T.StructField("params", T.MapType(_text, _text)),
        T.StructField("samples", T.MapType(_text, T.LongType())),
    ]
)

# Columns a table must have; the others are optional and simply stay absent.
REQUIRED = {
    "orders": ["web_order_id"],
    "articles": ["web_order_id", "box_id", "article_id", "article_weight_in_g"],
    "service_times": ["web_order_id", "driver_id", "service_time_in_minutes"],
    "driver_mapping": ["driver_id", "web_order_id"],
}

RAW = {
    "orders": ORDERS,
    "articles": ARTICLES,
    "service_times": SERVICE_TIMES,
    "driver_mapping": DRIVER_MAPPING,
}
