"""Binning rules as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def half_open_bin(value: Column, edges: Sequence[float]) -> Column:
    """Index of the interval (a, b] holding the value; null outside all of them."""
    picked = None
    for index in range(len(edges) - 1):
        inside = (value > F.lit(float(edges[index]))) & (value <= F.lit(float(edges[index + 1])))
        picked = F.when(inside, F.lit(index)) if picked is None else picked.when(inside, F.lit(index))
    return picked


def equal_width_class(value: Column, low: Column, high: Column, count: int) -> Column:
    """Index 0..count-1 of equal-width classes over [low, high], closed on the right."""
    width = (high - low) / F.lit(float(count))
    position = F.ceil(F.try_divide(value - low, width)) - 1
    return F.when(value.isNotNull(), F.greatest(F.least(F.coalesce(position, F.lit(0)), F.lit(count - 1)), F.lit(0))).cast("int")


def histogram_bin(value: Column, low: Column, high: Column, count: int) -> Column:
    """Index 0..count-1 of equal-width bins closed on the left, the last one on both ends."""
    share = F.try_divide((value - low) * F.lit(float(count)), high - low)
    return F.when(value.isNotNull(), F.least(F.floor(F.coalesce(share, F.lit(0.0))), F.lit(count - 1))).cast("int")


def magnitude_bin(value: Column, per_octave: int = 4096) -> Column:
    """A fine, order-preserving bin: logarithmic away from zero, linear next to it.

    The rule depends on the value alone, so any two passes over the data agree on
    it, and there are at most a few hundred thousand bins for realistic measures
    however many rows there are.
    """
    size = F.floor(F.log2(F.abs(value) * F.lit(float(2**20)) + F.lit(1.0)) * F.lit(float(per_octave)))
    return F.when(value < 0, -size).otherwise(size).cast("long")
