"""Join keys in which null equals null, as one plain equality."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def null_safe_key(name: str) -> Column:
    """Text that is never null and differs for every value, null included.

    `<=>` would be planned as a pair of derived expressions per join, which hides
    the common partitioning of successive joins. A stored key keeps it visible.
    """
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))
