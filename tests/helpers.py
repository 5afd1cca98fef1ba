"""Small tables and comparisons shared by the tests."""

import math

import pandas as pd

from stopwise.sources.schemas import ARTICLES, DRIVER_MAPPING, ORDERS, SERVICE_TIMES
from stopwise.sources.tables import Tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def make_tables(spark, orders=(), articles=(), service_times=(), driver_mapping=()):
    """Tables from dicts; columns not named are null."""

    def build(rows, schema):
        names = schema.fieldNames()
        return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schema)

    return Tables(
        orders=build(orders, ORDERS),
        articles=build(articles, ARTICLES),
        service_times=build(service_times, SERVICE_TIMES),
        driver_mapping=build(driver_mapping, DRIVER_MAPPING),
    )


def collected(df, *names):
    picked = df.select(*names) if names else df
    return sorted((tuple(row) for row in picked.collect()), key=str)


def same(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


def pandas_rows(pdf: pd.DataFrame, names):
    cleaned = pdf[names].astype(object).where(pdf[names].notna(), None)
    return sorted((tuple(row) for row in cleaned.itertuples(index=False)), key=str)
