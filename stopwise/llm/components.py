"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.llm.cluster import stored

THINNINGS = 2


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join the same nodes: of the smaller neighbours of a node only the least
    keeps its link to it, and the others are linked with that one instead.

    Near copies meet in many buckets, whose stars link each of them with many centres. Those centres
    are few, so what is left is little more than one link for each node.
    """
    least = F.min("a").over(Window.partitionBy("b"))
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct().select("a", "b", least.alias("least"))
    both = F.array(*[F.struct(F.col("least").alias("a"), F.col(end).alias("b")) for end in ("a", "b")])
    return ordered.select(F.explode(both).alias("link")).select("link.*").filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that links (a, b) join with another; a component is its smallest node.

    Each round a node takes the least label among its neighbours, then its label's own
    label, so paths shorten by doubling. A round joins all links, so they are thinned first.
    Rounds are written to shared storage; a node with very many neighbours is a sum over them,
    combined before the shuffle.
    """
    for _ in range(THINNINGS):
        links = thinned(links)
    links = stored(links, "thinned")
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")), "links")
    labels = stored(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("_near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        target = hooked.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        moved = stored(hooked.join(target, "component").select("node", F.col("_next").alias("component"), (F.col("_next") != F.col("_old")).alias("_moved")), "labels")
        labels = moved.select("node", "component")
        if not moved.filter("_moved").limit(1).count():
            return labels
