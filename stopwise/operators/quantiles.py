"""Exact order statistics, in one way at any size.

`percentile` would keep every distinct value of a group in one task. Here rows are
counted per magnitude bin (a small table), running sums over the bins tell which bin holds a
wanted rank, that bin is counted again in finer bins, and only the values of the last
bins are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stopwise.functions.bins import magnitude_bin

VALUE, WEIGHT, BIN, FINE = "__value", "__weight", "__bin", "__fine"
COUNT, START, END, TOTAL = "__count", "__start", "__end", "__total"

# Fine bins split a coarse one 65536 ways: a relative width of 3e-9, so that even a
# coarse bin holding a third of all rows falls apart into many.
FINE_PER_OCTAVE = 4096 * 65536

# Bin of null values. A filter on them would differ between the passes and keep Spark
# from reusing the exchanges below; an own bin, never wanted, does not.
UNKNOWN = -(2**62)


def _prepare(df: DataFrame, value: str, by: Sequence[str], weight: str | None) -> DataFrame:
    number = F.col(value).cast("double")
    number = F.when(~F.isnan(number), number)
    picked = df.select(*by, number.alias(VALUE), (F.col(weight) if weight else F.lit(1)).cast("long").alias(WEIGHT))
    picked = picked.withColumns(
        {
            BIN: F.coalesce(magnitude_bin(F.col(VALUE)), F.lit(UNKNOWN)),
            FINE: F.coalesce(magnitude_bin(F.col(VALUE), FINE_PER_OCTAVE), F.lit(UNKNOWN)),
        }
    )
    for name in by:
        picked = picked.filter(F.col(name).isNotNull())
    return picked


def _bin_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    known = F.col(VALUE).isNotNull()
    return rows.groupBy(*by, BIN).agg(
        F.coalesce(F.sum(F.when(known, F.col(WEIGHT))), F.lit(0)).alias(COUNT),
        F.sum(F.col(VALUE) * F.col(WEIGHT)).alias("__sum"),
    )


def _bin_ranges(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ranks [start, end) each coarse bin covers in its group."""
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    ordered = group.orderBy(BIN).rowsBetween(Window.unboundedPreceding, 0)
    ranges = bins.filter(F.col(COUNT) > 0).select(
        *by, BIN, COUNT, F.sum(COUNT).over(ordered).alias(END), F.sum(COUNT).over(group).alias(TOTAL)
    )
    return ranges.withColumn(START, F.col(END) - F.col(COUNT)).drop(COUNT)


def _fine_ranges(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same for the at most 65536 fine bins within each coarse one."""
    ordered = Window.partitionBy(*by, BIN).orderBy(FINE).rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.withColumn(END, F.col(START) + F.sum(COUNT).over(ordered))
    return ranges.select(*by, FINE, (F.col(END) - F.col(COUNT)).alias(START), END, TOTAL)


def _low_rank(q: float) -> Column:
    return F.floor((F.col(TOTAL) - 1) * F.lit(float(q)))


def _high_rank(q: float) -> Column:
    return F.ceil((F.col(TOTAL) - 1) * F.lit(float(q)))


def _wanted(ranges: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Bins that hold a wanted rank: at most two per probability and group."""
    chosen = F.lit(False)
    for q in probabilities:
        chosen = chosen | ((F.col(START) <= _high_rank(q)) & (F.col(END) > _low_rank(q)))
    return ranges.filter(chosen).drop(END)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles, one array per group, in the order asked for.

    Null values and null groups are left out. `few_groups` says that the number of
    groups is fixed by the report (hours, weekdays, labels), so that the list of
    wanted bins is small by construction and may be broadcast.
    """
    by = list(by)
    rows = _prepare(df, value, by, weight)
    bounded = few_groups or not by
    coarse = _wanted(_bin_ranges(_bin_counts(rows, by), by), probabilities)
    in_coarse = _counts_in(rows, coarse, by, BIN, FINE, bounded)
    fine = _wanted(_fine_ranges(in_coarse, by), probabilities)
    in_fine = _counts_in(rows, fine, by, FINE, VALUE, bounded)
    inside = Window.partitionBy(*by, FINE).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
    ranked = in_fine.withColumn("__upto", F.col(START) + F.sum(COUNT).over(inside))
    picks = []
    for index, q in enumerate(probabilities):
        picks.append(F.min(F.when(F.col("__upto") > _low_rank(q), F.col(VALUE))).alias(f"__low{index}"))
        picks.append(F.min(F.when(F.col("__upto") > _high_rank(q), F.col(VALUE))).alias(f"__high{index}"))
    grouped = ranked.groupBy(*by).agg(F.max(TOTAL).alias(TOTAL), *picks)
    values = []
    for index, q in enumerate(probabilities):
        part = (F.col(TOTAL) - 1) * F.lit(float(q)) - _low_rank(q)
        low, high = F.col(f"__low{index}"), F.col(f"__high{index}")
        values.append(low + (high - low) * part)
    return grouped.select(*by, F.array(values).alias("quantiles"))


def _counts_in(
    rows: DataFrame, wanted: DataFrame, by: Sequence[str], bin_name: str, detail: str, bounded: bool
) -> DataFrame:
    """Row counts per detail within the wanted bins, with the bins' first rank and total.

    A bounded list of bins is broadcast and filters the rows in the scan. Otherwise
    rows are counted before they meet the list, so crowded values move as one row; the
    list is spread by group and bin, lest the join settle for its partitioning by group.
    """
    keys = list(dict.fromkeys([*by, bin_name, detail]))
    if bounded:
        picked = rows.join(F.broadcast(wanted), [*by, bin_name])
        return picked.groupBy(*keys, START, TOTAL).agg(F.sum(WEIGHT).alias(COUNT))
    return rows.groupBy(*keys).agg(F.sum(WEIGHT).alias(COUNT)).join(wanted.repartition(*by, bin_name), [*by, bin_name])


def grouped_summary(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    few_groups: bool = False,
) -> DataFrame:
    """Mean, exact median and count of the value per group; null groups drop out."""
    by = list(by)
    rows = _prepare(df, value, by, None)
    bins = _bin_counts(rows, by)
    totals = bins.groupBy(*by).agg(F.sum(COUNT).alias("count"), F.sum("__sum").alias("__sum"))
    medians = exact_quantiles(df, value, [0.5], by, None, few_groups)
    return totals.join(medians, by, "left").select(
        *by,
        F.try_divide("__sum", "count").alias("mean"),
        F.get("quantiles", F.lit(0)).alias("median"),
        "count",
    )


# A coarse bin of more rows is taken apart by fine bins; there are at most total / CROWDED of them.
CROWDED = 1_000_000


def running_counts(df: DataFrame, value: str, weight: str | None = None, crowded: int = CROWDED) -> DataFrame:
    """Distinct values with their count, the number of rows up to them, and the total.

    Values are ordered bin by bin in parallel; only the coarse bins' totals, a small
    table, are summed in one place. Rows are shuffled once, by coarse bin, where counting and
    ordering both take place; a bin of very many rows is counted and ordered by its fine bins.
    """
    rows = _prepare(df, value, [], weight)
    coarse = _bin_ranges(_bin_counts(rows, []), []).withColumn("__many", F.col(END) - F.col(START) > crowded).drop(END)
    placed = rows.filter(F.col(VALUE).isNotNull()).join(F.broadcast(coarse), BIN)
    few, many = placed.filter(~F.col("__many")), placed.filter("__many")

    def ranked(counts: DataFrame, part: str) -> DataFrame:
        inside = Window.partitionBy(part).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(
            F.col(VALUE).alias("value"),
            F.col(COUNT).alias("count"),
            (F.col(START) + F.sum(COUNT).over(inside)).alias("upto"),
            F.col(TOTAL).alias("total"),
        )

    by_bin = few.select(BIN, VALUE, WEIGHT).repartition(BIN).groupBy(BIN, VALUE).agg(F.sum(WEIGHT).alias(COUNT)).join(F.broadcast(coarse), BIN)
    fine = _fine_ranges(many.groupBy(BIN, FINE, START, TOTAL).agg(F.sum(WEIGHT).alias(COUNT)), []).drop(END)
    by_fine = many.groupBy(FINE, VALUE).agg(F.sum(WEIGHT).alias(COUNT)).join(fine, FINE)
    return ranked(by_bin, BIN).unionByName(ranked(by_fine, FINE))
