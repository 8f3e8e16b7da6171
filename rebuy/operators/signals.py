"""Time-decayed implicit-feedback signals and their per-customer totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rebuy.config import EVENT_TYPES, HybridConfig
from rebuy.functions.scoring import event_points, every, purchase_points, strength, total_points, valid_item, within
from rebuy.operators.customers import only_customers
from rebuy.operators.topk import top_n_shares
from rebuy.sources.tables import ShopTables


def purchase_signals(transactions: DataFrame, start: str | None, end: str, anchor: str, half_life_days: float) -> DataFrame:
    return transactions.filter(every([within(transactions, "updated_date", start, end), valid_item()])).select(
        "customer_id",
        "item_id",
        F.lit("purchase").alias("signal"),
        F.col("updated_date").alias("signal_date"),
        purchase_points(anchor, half_life_days).alias("points"),
    )


def event_signals(events: DataFrame, start: str | None, end: str, anchor: str, half_life_days: float) -> DataFrame:
    wanted = [within(events, "event_date", start, end), F.col("event_type").isin(*EVENT_TYPES), valid_item()]
    return events.filter(every(wanted)).select(
        "customer_id",
        "item_id",
        F.col("event_type").alias("signal"),
        F.col("event_date").alias("signal_date"),
        event_points(anchor, half_life_days).alias("points"),
    )


def train_signals(tables: ShopTables, cfg: HybridConfig) -> DataFrame:
    """Purchases before the cutoff, and (optionally) events since ``event_start``."""
    bought = purchase_signals(tables.transactions, None, cfg.cutoff, cfg.cutoff, cfg.half_life_days)
    if not cfg.include_events:
        return bought
    browsed = event_signals(tables.events, cfg.event_start, cfg.cutoff, cfg.cutoff, cfg.half_life_days)
    return bought.unionByName(browsed)


def customer_items(signals: DataFrame) -> DataFrame:
    """One row per (customer, item): the only full pass over the signals.

    Popularity, history, group tops and the seen flag all derive from it.
    """
    return signals.groupBy("customer_id", "item_id").agg(
        total_points().alias("points"),
        F.max("signal_date").alias("last_date"),
        F.count("*").alias("n"),
    )


def user_history(pairs: DataFrame, max_user_items: int, customers: DataFrame | None = None) -> DataFrame:
    """Best items per customer by points, then recency; scores relative to the best item."""
    if customers is not None:
        pairs = only_customers(pairs, customers)
    order = [strength().desc(), F.desc("last_date"), F.col("item_id")]
    return top_n_shares(pairs, ["customer_id"], order, max_user_items).select(
        "customer_id", "item_id", "score", "rnk"
    )
