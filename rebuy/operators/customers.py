"""Who is recommended to, who is measured, and what they bought."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rebuy.config import HybridConfig
from rebuy.functions.scoring import within
from rebuy.sources.tables import ShopTables


def only_customers(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows of the given customers.

    Written after an aggregation by customer: Catalyst moves the semi-join
    below it when ``customers`` is small enough to broadcast, and otherwise
    the aggregated rows are what is shuffled.
    """
    return rows.join(customers.select("customer_id"), "customer_id", "left_semi")


def buyers(transactions: DataFrame, start: str, end: str) -> DataFrame:
    return transactions.filter(within(transactions, "updated_date", start, end)).select("customer_id").distinct()


def target_customers(tables: ShopTables, cfg: HybridConfig, mode: str = "validate") -> DataFrame:
    """Buyers of the validation window, or (``predict``) every known customer."""
    if mode == "validate":
        return buyers(tables.transactions, cfg.cutoff, cfg.valid_end)
    if mode != "predict":
        raise ValueError(f"mode must be validate or predict, not {mode!r}")
    known = tables.transactions.select("customer_id")
    if cfg.include_events:
        known = known.unionByName(tables.events.select("customer_id"))
    return known.distinct()


def truth(transactions: DataFrame, start: str, end: str, customers: DataFrame | None = None) -> DataFrame:
    """Distinct (customer, item) purchases of the window."""
    bought = transactions.filter(within(transactions, "updated_date", start, end)).select("customer_id", "item_id").distinct()
    return bought if customers is None else only_customers(bought, customers)


def sample_customers(transactions: DataFrame, start: str, end: str, n: int, seed: int) -> DataFrame:
    """``n`` buyers of the window: the first by md5 of id and seed.

    Same rows as a global sort with a limit, but no task ever sees them all:
    a histogram over the leading hash digits (at most 65,536 rows) gives each
    digit group its offset, and ranks are taken inside the groups.
    """
    hashed = (
        buyers(transactions, start, end)
        .withColumn("digest", F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f":{seed}"))))
        .withColumn("lead", F.substring("digest", 1, 4))
    )
    running = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("lead")
        .agg(F.count("*").alias("size"))
        .withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .filter(F.col("ahead") < n)
        .select("lead", "ahead")
    )
    inside = Window.partitionBy("lead").orderBy("digest", "customer_id")
    return (
        hashed.join(F.broadcast(offsets), "lead")
        .withColumn("place", F.col("ahead") + F.row_number().over(inside))
        .filter(F.col("place") <= n)
        .select("customer_id")
    )
