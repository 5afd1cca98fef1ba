"""Hot join keys: find them cheaply, then spread them over many tasks.

A key that fills more than a couple of shuffle partitions is cut into pieces. The
side with many rows per key gets a piece number per row; the other side repeats
its rows of that key once per piece. Every pair of rows still meets exactly once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stopwise.session import shuffle_partitions


# Pieces go to partitions by hash; small ones even out.
PIECES_PER_PARTITION = 4


@dataclass(frozen=True)
class HotKeys:
    """At most half as many rows as there are shuffle partitions, so safe to broadcast."""

    columns: tuple[str, ...]
    frame: DataFrame

    def mark(self, df: DataFrame, pieces: str) -> DataFrame:
        """Add the number of pieces of each row's key; null for ordinary keys.

        A null key can be hot too: even rows that match nothing must not all sit in one task.
        """
        listed = self.frame.select(*[F.col(name).alias(f"__hot_{name}") for name in self.columns], F.col("pieces").alias(pieces))
        same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"__hot_{name}")) for name in self.columns])
        return df.join(F.broadcast(listed), same, "left").drop(*[f"__hot_{name}" for name in self.columns])


def find_hot_keys(
    df: DataFrame,
    columns: Sequence[str],
    fraction: float = 0.001,
    min_hits: int = 32,
    partitions: int | None = None,
) -> HotKeys | None:
    """Keys holding more than two average partitions, judged from a thin sample.

    The sample only steers how work is spread: a missed key costs balance, never a
    row. Each hit holds over 2/partitions of the sample, which bounds the list, and
    all pieces together are at most a few times the number of partitions.
    """
    spark = df.sparkSession
    partitions = partitions or shuffle_partitions(spark)
    sample = df.select(*columns).sample(fraction, seed=17)
    # One pass counts each key and, as the empty grouping set, the whole sample.
    names = [F.col(name) for name in columns]
    counts = sample.groupingSets([names, []], *names).agg(
        F.count(F.lit(1)).alias("hits"), (F.grouping_id() > 0).alias("whole")
    )
    top = (
        counts.filter(F.col("whole") | (F.col("hits") >= min_hits))
        .orderBy(F.desc("whole"), F.desc("hits"))
        .limit(max(partitions // 2, 1) + 1)
        .collect()
    )
    total = top[0]["hits"] if top else 0
    rows = [
        (*row[: len(columns)], math.ceil(PIECES_PER_PARTITION * row["hits"] * partitions / total))
        for row in top[1:]
        if row["hits"] * partitions > 2 * total
    ]
    if not rows:
        return None
    schema = df.select(*columns).schema.add("pieces", T.IntegerType())
    return HotKeys(tuple(columns), spark.createDataFrame(rows, schema))


def row_piece(pieces: Column, columns: Sequence[str], seed: int = 17) -> Column:
    """A piece number per row, from a hash of the whole row: a task that runs again gives
    every row the number it had, whatever the rows were computed from."""
    return F.when(pieces.isNotNull(), F.pmod(F.xxhash64(F.lit(seed), *columns), pieces)).otherwise(0).cast("int")


def every_piece(pieces: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str,
    hot: HotKeys | None,
    piece: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Join to a side with one row per key; the left side may have hot keys.

    Keys and piece are joined as one struct column, so that rows are shuffled by the
    whole of it even where the right side is already partitioned by the keys. Null
    keys match nothing, as in any equality join.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if hot is None:
        return left.join(right, keys, how)
    for name in keys:
        right = right.filter(F.col(name).isNotNull())
    row = left.columns
    left, right = hot.mark(left, "__pieces"), hot.mark(right, "__pieces")
    own = piece(F.col("__pieces")) if piece else row_piece(F.col("__pieces"), row)
    left = left.withColumn("__piece", own)
    right = right.withColumn("__piece", every_piece(F.col("__pieces")))
    whole = F.struct(*keys, "__piece")
    left = left.withColumn("__spread", whole).drop("__pieces", "__piece")
    right = right.withColumn("__spread", whole).drop("__pieces", "__piece", *keys)
    return left.join(right, "__spread", how).drop("__spread")
