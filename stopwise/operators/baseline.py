"""A rule model: the mean target of each combination of a few features.

It is the yardstick for the trained model, and plain SQL can reproduce it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stopwise.config import TARGET
from stopwise.operators.skew import find_hot_keys, lookup_join
from stopwise.session import scratch_path

FEW = 100_000  # cells of a few numbers each, so some MB to broadcast


@dataclass(frozen=True)
class RuleModel:
    keys: tuple[str, ...]
    cells: DataFrame
    default: float | None
    few: bool = False  # counted: at most FEW cells

    def transform(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        """Add the cell mean, or the overall mean where the combination is new."""
        cells = self.cells.withColumnRenamed("cell_mean", "__mean")
        found = df.join(F.broadcast(cells), list(self.keys), "left") if self.few else self._spread_join(df, cells)
        return found.withColumn(output, F.coalesce("__mean", F.lit(self.default))).drop("__mean")

    def _spread_join(self, df: DataFrame, cells: DataFrame) -> DataFrame:
        """For a model of very many cells: left to adaptive execution, with crowded cells cut into pieces by row digest."""
        keys = list(self.keys)

        def by_row(pieces: Column) -> Column:
            return F.coalesce(F.pmod(F.xxhash64(*df.columns), pieces), F.lit(0)).cast("int")

        return lookup_join(df, cells, keys, "left", find_hot_keys(df, keys), by_row)


def fit_rule(df: DataFrame, keys: Sequence[str] = ("floor", "has_elevator"), target: str = TARGET) -> RuleModel:
    """Fit like any estimator; the cells are stored as a table, however many they are. Up to FEW of
    them are sent to the rows, which then need no shuffle."""
    cells = df.groupBy(*keys).agg(F.avg(target).alias("cell_mean"))
    path = scratch_path(df.sparkSession, "rule_cells")
    cells.write.parquet(path)
    cells = df.sparkSession.read.schema(cells.schema).parquet(path)
    default = df.agg(F.avg(target).alias("mean")).first()["mean"]
    return RuleModel(tuple(keys), cells, default, cells.limit(FEW + 1).count() <= FEW)


def fold(key: Column, folds: int, seed: int = 42) -> Column:
    """The fold of a row, from its key's digest; all rows of an order share one."""
    digest = F.md5(F.concat(F.lit(f"fold-{seed}:"), F.coalesce(key, F.lit(""))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def cross_validated(df: DataFrame, keys: Sequence[str] = ("floor", "has_elevator"), folds: int = 5, target: str = TARGET, key: str = "web_order_id") -> DataFrame:
    """Every row with its `fold` and the prediction of the rule fitted on all other folds.

    One aggregate by cell and fold serves all models: a model's sums are the totals less
    those of its own fold. A cell known from its own fold only takes the mean of all other folds.
    """
    rows = df.withColumn("fold", fold(F.col(key), folds))
    sums = rows.groupBy(*keys, "fold").agg(F.sum(target).alias("__sum"), F.count(target).alias("__n"))
    by_fold = sums.groupBy("fold").agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))  # a row for each fold
    whole = by_fold.agg(F.sum("__sum").alias("__all"), F.sum("__n").alias("__count"))
    rest = by_fold.join(F.broadcast(whole)).select("fold", F.try_divide(F.col("__all") - F.col("__sum"), F.col("__count") - F.col("__n")).alias("__default"))
    totals = sums.groupBy(*keys).agg(F.sum("__sum").alias("__all"), F.sum("__n").alias("__count"), F.collect_list(F.struct("fold", "__sum", "__n")).alias("__own"))
    own = F.explode("__own").alias("__own")  # at most one entry for each fold
    model = totals.select(*keys, own, "__all", "__count").select(
        *keys, F.col("__own.fold").alias("fold"), F.try_divide(F.col("__all") - F.col("__own.__sum"), F.col("__count") - F.col("__own.__n")).alias("__mean")
    )
    parts = [*keys, "fold"]
    found = lookup_join(rows, model, parts, "left", find_hot_keys(rows, parts)).join(F.broadcast(rest), "fold", "left")
    return found.withColumn("predicted", F.coalesce("__mean", "__default")).drop("__mean", "__default")
