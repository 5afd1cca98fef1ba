"""Articles rolled up to one row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def aggregate_articles(articles: DataFrame, key: str = "web_order_id") -> DataFrame:
    """Boxes, articles and weights per order; rows without an order drop out.

    Distinct boxes are counted on (order, box) partial groups, so an order with a
    third of all articles is already small when its groups meet.
    """
    weight = F.col("article_weight_in_g")
    rolled = (
        articles.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count_distinct("box_id").alias("total_boxes"),
            F.count("article_id").alias("total_articles"),
            F.sum(weight).alias("__sum"),
            F.count(weight).alias("__known"),
            F.max(weight).alias("max_article_weight_g"),
            F.min(weight).alias("min_article_weight_g"),
        )
    )
    # One sum serves total and mean, which makes the partial groups narrower.
    return rolled.select(
        key,
        "total_boxes",
        "total_articles",
        F.coalesce("__sum", F.lit(0.0)).alias("total_weight_g"),
        F.try_divide("__sum", "__known").alias("avg_article_weight_g"),
        "max_article_weight_g",
        "min_article_weight_g",
    )
