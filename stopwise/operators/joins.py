"""Service times joined to orders, article roll-up and driver mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stopwise.functions.keys import null_safe_key
from stopwise.operators.articles import aggregate_articles
from stopwise.operators.rows import repeat_rows
from stopwise.operators.skew import HotKeys, every_piece, find_hot_keys, row_piece
from stopwise.sources.tables import Tables

ORDER, DRIVER, SPREAD, SLICE = "__order", "__driver", "__spread", "__slice"


@dataclass(frozen=True)
class SkewPlan:
    """Which keys to spread. All three lists are bounded; None means nothing is hot."""

    visits: HotKeys | None = None
    visit_pairs: HotKeys | None = None
    orders: HotKeys | None = None


def measure_skew(tables: Tables, null_safe: bool = False, **sampling) -> SkewPlan:
    """Three thin key samples; nothing but keys is read."""
    visits = _keyed(tables.service_times, null_safe)
    hot_visits = find_hot_keys(visits, [ORDER], **sampling)
    return SkewPlan(
        visits=hot_visits,
        visit_pairs=find_hot_keys(visits, [ORDER, DRIVER], **sampling) if hot_visits else None,
        orders=find_hot_keys(tables.orders.withColumn(ORDER, _key("web_order_id", null_safe)), [ORDER], **sampling),
    )


def _key(name: str, null_safe: bool) -> Column:
    """The join key: null meets null, or, where keys are declared never null, nothing."""
    return null_safe_key(name) if null_safe else F.concat(F.lit("="), F.col(name))


def _keyed(df: DataFrame, null_safe: bool) -> DataFrame:
    return df.withColumns({ORDER: _key("web_order_id", null_safe), DRIVER: _key("driver_id", null_safe)})


def _driver_piece(pieces: Column) -> Column:
    return F.when(pieces.isNotNull(), F.pmod(F.xxhash64(DRIVER), pieces)).otherwise(0).cast("int")


def _spread_key(pieces: Column, piece: Column) -> Column:
    """Order key and piece in one column, so that rows are shuffled by both.

    As two columns, Spark may settle for a partitioning by the order alone where the
    other side has it already. No plain key starts with a tilde.
    """
    marked = F.concat(F.lit("~"), piece.cast("string"), F.col(ORDER))
    return F.when(pieces.isNotNull(), marked).otherwise(F.col(ORDER))


def _visit_side(visits: DataFrame, null_safe: bool, skew: SkewPlan) -> DataFrame:
    """The fact side. A hot order is spread by driver, a hot (order, driver) pair by its whole rows."""
    visits = _keyed(visits, null_safe)
    row = visits.columns
    if skew.visits is None:
        return visits
    visits = skew.visits.mark(visits, "__pieces")
    piece = _driver_piece(F.col("__pieces"))
    if skew.visit_pairs is not None:
        visits = skew.visit_pairs.mark(visits, "__pair")
        piece = F.when(F.col("__pair").isNotNull(), row_piece(F.col("__pieces"), row)).otherwise(piece)
    return visits.withColumn(SPREAD, _spread_key(F.col("__pieces"), piece)).drop("__pieces", "__pair")


def _order_side(df: DataFrame, skew: SkewPlan) -> DataFrame:
    """A side keyed by order: hot orders once per piece."""
    if skew.visits is None:
        return df
    pieces = F.col("__pieces")
    placed = skew.visits.mark(df, "__pieces").withColumn("__piece", every_piece(pieces))
    return placed.withColumn(SPREAD, _spread_key(pieces, F.col("__piece"))).drop("__pieces", "__piece")


def _mapping_side(mapping: DataFrame, null_safe: bool, skew: SkewPlan) -> DataFrame:
    """One row per (order, driver) with its number of mapping rows."""
    pairs = _keyed(mapping.select("driver_id", "web_order_id"), null_safe)
    pairs = pairs.groupBy(ORDER, DRIVER).agg(F.count(F.lit(1)).alias("mapping_rows"))
    if skew.visits is None:
        return pairs
    pairs = skew.visits.mark(pairs, "__pieces")
    own = _driver_piece(F.col("__pieces"))
    places = F.array(own)
    if skew.visit_pairs is not None:
        pairs = skew.visit_pairs.mark(pairs, "__pair")
        everywhere = F.sequence(F.lit(0), F.col("__pieces") - 1)
        places = F.when(F.col("__pair").isNotNull(), everywhere).otherwise(places)
    placed = pairs.withColumn("__piece", F.explode(places))
    placed = placed.withColumn(SPREAD, _spread_key(F.col("__pieces"), F.col("__piece")))
    return placed.drop("__pieces", "__pair", "__piece", ORDER)


def _order_key(skew: SkewPlan) -> str:
    return ORDER if skew.visits is None else SPREAD


def _join_by_order(visits: DataFrame, side: DataFrame, skew: SkewPlan) -> DataFrame:
    key = _order_key(skew)
    return visits.join(side if key == ORDER else side.drop(ORDER), key, "left")


def _renamed_orders(orders: DataFrame, visits: DataFrame, null_safe: bool) -> DataFrame:
    """Orders ready to join: key column, other columns suffixed where the name is taken."""
    columns = [
        F.col(name).alias(f"{name}_order" if name in visits.columns else name)
        for name in orders.columns
        if name != "web_order_id"
    ]
    return orders.select(_key("web_order_id", null_safe).alias(ORDER), *columns)


def _join_order_rows(visits: DataFrame, orders: DataFrame, skew: SkewPlan) -> DataFrame:
    """Left join; if one order id fills much of `orders`, that id is cut on both sides.

    The visit repeats once per slice of such an id. The id exists on the right, so
    the visit matches in at least one slice, and repeats without a match go.
    """
    orders = _order_side(orders, skew)
    if skew.orders is None:
        return _join_by_order(visits, orders, skew)
    slice_key = F.concat(F.col(_order_key(skew)), F.lit("#"), F.col("__cut").cast("string"))
    orders = (
        skew.orders.mark(orders, "__slices")
        .withColumn("__cut", row_piece(F.col("__slices"), orders.columns, seed=29))
        .withColumns({SLICE: slice_key, "__found": F.lit(True)})
        .drop(ORDER, SPREAD, "__slices", "__cut")
    )
    visits = (
        skew.orders.mark(visits, "__slices")
        .withColumn("__cut", every_piece(F.col("__slices")))
        .withColumn(SLICE, slice_key)
    )
    joined = visits.join(orders, SLICE, "left")
    return joined.filter(F.col("__slices").isNull() | F.col("__found")).drop("__slices", "__cut", SLICE, "__found")


def _article_side(articles: DataFrame, null_safe: bool, skew: SkewPlan) -> DataFrame:
    keyed = articles.filter(F.col("web_order_id").isNotNull()).withColumn(ORDER, _key("web_order_id", null_safe))
    return _order_side(aggregate_articles(keyed, ORDER), skew)


def _finish(df: DataFrame) -> DataFrame:
    return df.drop(ORDER, DRIVER, SPREAD)


def join_orders(tables: Tables, null_safe: bool = False, skew: SkewPlan = SkewPlan()) -> DataFrame:
    """Every service time with its order, or nulls; doubled order ids fan out."""
    visits = _visit_side(tables.service_times, null_safe, skew)
    orders = _renamed_orders(tables.orders, tables.service_times, null_safe)
    return _finish(_join_order_rows(visits, orders, skew))


def join_articles(tables: Tables, null_safe: bool = False, skew: SkewPlan = SkewPlan()) -> DataFrame:
    """Every service time with its order's article measures."""
    visits = _visit_side(tables.service_times, null_safe, skew)
    return _finish(_join_by_order(visits, _article_side(tables.articles, null_safe, skew), skew))


def join_mapping(tables: Tables, null_safe: bool = False, skew: SkewPlan = SkewPlan()) -> DataFrame:
    """Every service time as often as its (driver, order) pair is mapped, at least once."""
    visits = _visit_side(tables.service_times, null_safe, skew)
    return _finish(_join_mapping(visits, tables, null_safe, skew).drop("mapping_rows"))


def _join_mapping(visits: DataFrame, tables: Tables, null_safe: bool, skew: SkewPlan) -> DataFrame:
    mapping = _mapping_side(tables.driver_mapping, null_safe, skew)
    joined = visits.join(mapping, [_order_key(skew), DRIVER], "left")
    return repeat_rows(joined, F.coalesce("mapping_rows", F.lit(1)))


def check_mapping(tables: Tables, null_safe: bool = False, skew: SkewPlan = SkewPlan()) -> DataFrame:
    """The joined rows with the verdict the mapping join yields: both or left_only."""
    visits = _visit_side(tables.service_times, null_safe, skew)
    joined = _join_mapping(visits, tables, null_safe, skew)
    verdict = F.when(F.col("mapping_rows").isNull(), "left_only").otherwise("both")
    return _finish(joined.withColumn("mapping_check", verdict).drop("mapping_rows"))


def explore_frame(tables: Tables, null_safe: bool = False, skew: SkewPlan = SkewPlan()) -> DataFrame:
    """Service times with orders and article measures: the uncleaned rows that get explored."""
    visits = _visit_side(tables.service_times, null_safe, skew)
    visits = _join_by_order(visits, _article_side(tables.articles, null_safe, skew), skew)
    orders = _renamed_orders(tables.orders, tables.service_times, null_safe)
    return _finish(_join_order_rows(visits, orders, skew))


def join_datasets(
    tables: Tables,
    null_safe: bool = False,
    skew: SkewPlan = SkewPlan(),
    dedupe_mapping: bool = False,
) -> DataFrame:
    """All tables in one row per service time; more where order or mapping is doubled.

    Both roll-ups and the orders are partitioned by order, so the fact rows are
    shuffled once (with `requireAllClusterKeysForCoPartition` off).
    """
    visits = _visit_side(tables.service_times, null_safe, skew)
    visits = _join_by_order(visits, _article_side(tables.articles, null_safe, skew), skew)
    if not dedupe_mapping:
        visits = _join_mapping(visits, tables, null_safe, skew).drop("mapping_rows")
    orders = _renamed_orders(tables.orders, tables.service_times, null_safe)
    return _finish(_join_order_rows(visits, orders, skew))


def row_weights(tables: Tables, null_safe: bool = False, skew: SkewPlan = SkewPlan(), dedupe_mapping: bool = False) -> DataFrame:
    """Service times with the number of joined rows each one yields.

    Counts per key stand in for the other tables, so statistics of the joined
    rows' own measures need no wide join.
    """
    visits = _visit_side(tables.service_times, null_safe, skew)
    orders = tables.orders.select(_key("web_order_id", null_safe).alias(ORDER))
    orders = orders.groupBy(ORDER).agg(F.count(F.lit(1)).alias("order_rows"))
    visits = _join_by_order(visits, _order_side(orders, skew), skew)
    visits = visits.withColumn("order_weight", F.coalesce("order_rows", F.lit(1)))
    weight = F.col("order_weight")
    if not dedupe_mapping:
        visits = visits.join(_mapping_side(tables.driver_mapping, null_safe, skew), [_order_key(skew), DRIVER], "left")
        weight = weight * F.coalesce("mapping_rows", F.lit(1))
    return _finish(visits.withColumn("row_weight", weight).drop("order_rows", "mapping_rows"))
