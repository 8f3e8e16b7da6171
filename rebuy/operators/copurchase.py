"""Items bought in the same basket."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rebuy.config import HybridConfig
from rebuy.functions.scoring import before, strength
from rebuy.operators.topk import top_n, top_n_shares
from rebuy.session import kept
from rebuy.sources.tables import ShopTables


def baskets(transactions: DataFrame, cutoff: str, max_basket_items: int) -> DataFrame:
    """Bills of 2 to ``max_basket_items`` distinct items, as item lists.

    Items are first made distinct per bill, then each bill is cut to
    ``max_basket_items + 1`` items on the map side. A bill that still has
    the extra item is over the limit, so an endless bill is never gathered.
    """
    lines = transactions.filter(before(transactions, "updated_date", cutoff)).select("bill_id", "item_id").dropna().distinct()
    capped = top_n(lines, ["bill_id"], [F.col("item_id")], max_basket_items + 1)
    gathered = capped.groupBy("bill_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return gathered.filter(F.size("items").between(2, max_basket_items))


def copurchase_neighbors(transactions: DataFrame, cutoff: str, max_basket_items: int, max_neighbors: int) -> DataFrame:
    """Top neighbours per item by summed ``1 / (basket size - 1)``, relative to the best one.

    Each unordered pair of a basket is emitted once (at most
    ``n * (n - 1) / 2`` for the largest allowed basket), summed map-side and
    shuffled on the pair; only the sums are mirrored.
    """
    share = F.lit(1.0) / (F.size("items") - 1)
    firsts = baskets(transactions, cutoff, max_basket_items).select(
        "items", share.alias("weight"), F.posexplode("items").alias("pos", "item_id")
    )
    later = F.slice("items", F.col("pos") + 2, F.size("items"))
    pairs = firsts.select("item_id", "weight", F.explode(later).alias("neighbor_id"))
    return top_neighbors(pairs.groupBy("item_id", "neighbor_id").agg(F.sum("weight").alias("points")), max_neighbors)


def top_neighbors(sums: DataFrame, max_neighbors: int) -> DataFrame:
    """Top neighbours of each item from the points of unordered pairs."""
    a, b = F.col("item_id"), F.col("neighbor_id")
    mirrored = F.array(
        F.struct(a.alias("item_id"), b.alias("neighbor_id")), F.struct(b.alias("item_id"), a.alias("neighbor_id"))
    )
    weights = sums.select("points", F.inline(mirrored))
    order = [strength().desc(), F.col("neighbor_id")]
    return top_n_shares(weights, ["item_id"], order, max_neighbors).select(
        "item_id", "neighbor_id", F.col("points").alias("weight"), "score", "rnk"
    )


def adjacency(neighbors: DataFrame) -> DataFrame:
    """One row per item with its (bounded) neighbour list: joins move one row per seed."""
    entry = F.struct("neighbor_id", "score")
    return neighbors.groupBy("item_id").agg(F.collect_list(entry).alias("near"))


def cached_neighbors(tables: ShopTables, cfg: HybridConfig, folder: str | None = None) -> DataFrame:
    """Neighbour table kept in the shared folder, reused only for the very same key.

    Each writer uses a new folder below the key's, and only finished folders
    are read, so no table that somebody reads is ever overwritten. Tables
    without a source key are not shared.
    """
    fresh = copurchase_neighbors(tables.transactions, cfg.cutoff, cfg.max_basket_items, cfg.max_neighbors)
    key = f"{tables.source_key}|{cfg.cutoff}|{cfg.max_basket_items}|{cfg.max_neighbors}" if tables.source_key else ""
    return kept(tables.spark, "neighbors", key, lambda: fresh, folder)
