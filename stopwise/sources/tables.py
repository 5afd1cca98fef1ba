"""The four raw tables: read, check, conform; and the processed data set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stopwise.config import FEATURES, TARGET
from stopwise.sources import schemas

# File names of the raw data set.
FILES = {
    "orders": "orders.parquet",
    "articles": "articles.parquet",
    "service_times": "service_times.parquet",
    "driver_mapping": "driver_order_mapping.parquet",
}


ROW_GROUP = 32 << 20  # bytes; what a lookup reads at least
SCAN_GROUP = 16 << 20  # bytes; a scan cannot split a row group, and learners keep several times its size in memory


@dataclass(frozen=True)
class Tables:
    orders: DataFrame
    articles: DataFrame
    service_times: DataFrame
    driver_mapping: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [
            ("orders", self.orders),
            ("articles", self.articles),
            ("service_times", self.service_times),
            ("driver_mapping", self.driver_mapping),
        ]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared types, turn NaN into null, reject missing columns.

    Optional columns that are not there stay away; unknown ones are dropped by
    the projection, so they are never read from Parquet.
    """
    missing = [column for column in schemas.REQUIRED[name] if column not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    picked = []
    for declared in schemas.RAW[name]:
        if declared.name not in df.columns:
            continue
        value = F.col(declared.name)
        if df.schema[declared.name].dataType != declared.dataType:
            value = value.cast(declared.dataType)
        if isinstance(declared.dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        picked.append(value.alias(declared.name))
    return df.select(picked)


def load_table(spark: SparkSession, raw_dir: str, name: str) -> DataFrame:
    return conform(spark.read.parquet(f"{raw_dir.rstrip('/')}/{FILES[name]}"), name)


def load_orders(spark: SparkSession, raw_dir: str) -> DataFrame:
    return load_table(spark, raw_dir, "orders")


def load_articles(spark: SparkSession, raw_dir: str) -> DataFrame:
    return load_table(spark, raw_dir, "articles")


def load_service_times(spark: SparkSession, raw_dir: str) -> DataFrame:
    return load_table(spark, raw_dir, "service_times")


def load_driver_mapping(spark: SparkSession, raw_dir: str) -> DataFrame:
    return load_table(spark, raw_dir, "driver_mapping")


def load_all(spark: SparkSession, raw_dir: str) -> Tables:
    return Tables(**{name: load_table(spark, raw_dir, name) for name in FILES})


def write_processed(df: DataFrame, processed_dir: str, row_group: int = SCAN_GROUP) -> None:
    """One write of the joined, cleaned, derived rows, in row groups of bounded size, so that a task reads as much however large the files are.

    Features and target are column subsets of it, which Parquet reads alone, so
    no second and third copy is stored.
    """
    df.write.mode("overwrite").option("parquet.block.size", row_group).parquet(f"{processed_dir.rstrip('/')}/full_dataset")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_processed(spark: SparkSession, processed_dir: str) -> DataFrame:
    return spark.read.parquet(f"{processed_dir.rstrip('/')}/full_dataset")


def read_features(spark: SparkSession, processed_dir: str) -> DataFrame:
    df = read_processed(spark, processed_dir)
    return df.select([name for name in FEATURES if name in df.columns])


def read_target(spark: SparkSession, processed_dir: str) -> DataFrame:
    return read_processed(spark, processed_dir).select(TARGET)


def findable(column: str, row_group: int = ROW_GROUP) -> dict[str, str]:
    """Parquet options for a table that is searched by a column: Bloom filters for it, in row groups
    of bounded size. Without a dictionary, which would take the filter's place."""
    return {
        "parquet.block.size": str(row_group),
        f"parquet.bloom.filter.enabled#{column}": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
        f"parquet.enable.dictionary#{column}": "false",
    }


def write_lookup(df: DataFrame, path: str, key: str, row_group: int = ROW_GROUP) -> None:
    """A table to search by `key`: rows dealt out and sorted by it, so that each row group is a narrow range."""
    ordered = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ordered.write.mode("overwrite").options(**findable(key, row_group)).parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: Sequence[str]) -> DataFrame:
    """The rows of some keys, as one request names them. Null finds nothing."""
    return spark.read.parquet(path).filter(F.col(key).isin(list(values)))
