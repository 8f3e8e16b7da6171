"""Popularity overall, per metadata group and per location."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rebuy.config import HybridConfig, metadata_levels
from rebuy.functions.scoring import before, purchase_points, ratio, strength, total_points
from rebuy.operators.customers import only_customers
from rebuy.operators.topk import head, top_n, top_n_shares


def item_totals(pairs: DataFrame) -> DataFrame:
    """Points, signal rows and customers per item, from the (customer, item) totals."""
    return pairs.groupBy("item_id").agg(
        F.sum("points").alias("points"),
        F.sum("n").alias("n"),
        F.count("*").alias("customers"),
    )


def global_scores(totals: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most popular items with their score relative to the best one.

    The list is the same for popularity and fallback. ``score`` is null
    throughout when the best item has no points: then nothing is scored and
    the ranks alone order the fallback.
    """
    order = [strength().desc(), F.desc("n"), F.col("item_id")]
    ranked = head(totals.select("item_id", "points", "n"), order, limit)
    best = ranked.agg(F.max("points")).scalar()
    return ranked.withColumn("score", F.when(best > 0, ratio(F.col("points"), best)))


def item_groups(items: DataFrame, category_level: str) -> DataFrame:
    """One (item, "level:value") row per level; missing values form the group ``unknown``.

    Repeated metadata rows of an item collapse to the greatest one.
    """
    levels = metadata_levels(category_level)
    known = [F.coalesce(level, F.lit("unknown")).alias(level) for level in levels]
    single = items.groupBy("item_id").agg(F.max(F.struct(*known)).alias("meta"))
    keys = [F.concat_ws(":", F.lit(level), F.col("meta")[level]) for level in levels]
    return single.select("item_id", F.explode(F.array(*keys)).alias("grp"))


def group_top_items(totals: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    joined = totals.select("item_id", "points").join(groups, "item_id")
    order = [strength().desc(), F.col("item_id")]
    return top_n_shares(joined, ["grp"], order, n).select("grp", "item_id", "score", "rnk")


def user_location(transactions: DataFrame, cutoff: str, customers: DataFrame) -> DataFrame:
    """The location with most rows per customer; the latest visit breaks ties."""
    visits = (
        transactions.filter(before(transactions, "updated_date", cutoff) & F.col("location").isNotNull())
        .groupBy("customer_id", "location")
        .agg(F.count("*").alias("n"), F.max("updated_date").alias("last_date"))
    )
    order = [F.desc("n"), F.desc("last_date"), F.col("location")]
    return top_n(only_customers(visits, customers), ["customer_id"], order, 1).select("customer_id", "location")


def location_top_items(transactions: DataFrame, cfg: HybridConfig) -> DataFrame:
    scored = (
        transactions.filter(before(transactions, "updated_date", cfg.cutoff) & F.col("location").isNotNull())
        .select("location", "item_id", purchase_points(cfg.cutoff, cfg.half_life_days).alias("points"))
        .groupBy("location", "item_id")
        .agg(total_points().alias("points"))
    )
    order = [strength().desc(), F.col("item_id")]
    return top_n_shares(scored, ["location"], order, cfg.max_location_items).select(
        "location", "item_id", "score", "rnk"
    )
