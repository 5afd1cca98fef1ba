"""Train, validation and test parts, and an exact-size sample, by hashing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from stopwise.config import TARGET
from stopwise.operators.rows import repeat_rows

BUCKETS = 1000


def bucket(key: Column, seed: int = 42) -> Column:
    """0..999 from the key's digest: the same on every run, partitioning and machine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int")


def split_name(number: Column, test_size: float = 0.2, validation_size: float = 0.1) -> Column:
    test, validation = round(test_size * BUCKETS), round((test_size + validation_size) * BUCKETS)
    return F.when(number < test, "test").when(number < validation, "val").otherwise("train")


def with_split(
    df: DataFrame, key: str = "web_order_id", seed: int = 42, test_size: float = 0.2, validation_size: float = 0.1
) -> DataFrame:
    """Mark every row; no shuffle, and all rows of an order land in the same part."""
    return df.withColumn("split", split_name(bucket(F.col(key), seed), test_size, validation_size))


def split_counts(df: DataFrame, key: str = "web_order_id", seed: int = 42) -> DataFrame:
    return with_split(df, key, seed).groupBy("split").agg(F.count(F.lit(1)).alias("row_count"))


def exact_sample(
    df: DataFrame, share: float = 0.05, seed: int = 42, keys: tuple[str, ...] = ("web_order_id", "driver_id"), value: str = TARGET
) -> DataFrame:
    """Exactly int(share * rows) rows, chosen by digest, without a global sort.

    Digest prefixes are counted, and those below the cut are taken whole in the scan.
    The prefix at the cut is counted once more by a longer prefix; what is left at the
    second cut, one row in four billion, is put in order. Equal rows are counted, not
    listed, so many copies of one row do no harm.
    """
    parts = [F.coalesce(F.col(name), F.lit("")) for name in keys]
    parts.append(F.coalesce(F.floor(F.col(value) * 1000000).cast("string"), F.lit("")))
    rows = df.withColumn("__digest", F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *parts))))
    wanted = None
    at_cut = rows
    taken = []
    for length in (4, 8):
        cut = _find_cut(at_cut, length, share, wanted)
        if cut is None:
            return df
        prefix = F.substring("__digest", 1, length)
        taken.append(at_cut.filter(prefix < cut["prefix"]).select(*df.columns))
        at_cut = at_cut.filter(prefix == cut["prefix"])
        wanted = cut["wanted"] - cut["before"]
    ordered = Window.orderBy("__digest", *df.columns).rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        at_cut.groupBy(*df.columns, "__digest")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__taken", F.least(F.col("__n"), F.lit(wanted) - (F.sum("__n").over(ordered) - F.col("__n"))))
        .filter(F.col("__taken") > 0)
    )
    edge = repeat_rows(edge, F.col("__taken")).select(*df.columns)
    return taken[0].unionByName(taken[1]).unionByName(edge)


def _find_cut(rows: DataFrame, length: int, share: float, wanted: int | None) -> Row | None:
    """The digest prefix at which the wanted number of rows is passed; 65536 prefixes at most."""
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.groupBy(F.substring("__digest", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    goal = F.floor(F.sum("n").over(Window.partitionBy()) * share) if wanted is None else F.lit(wanted)
    ranged = counted.select(
        "prefix", (F.sum("n").over(running) - F.col("n")).alias("before"), F.sum("n").over(running).alias("upto"), goal.alias("wanted")
    )
    return ranged.filter(F.col("upto") > F.col("wanted")).orderBy("prefix").first()
