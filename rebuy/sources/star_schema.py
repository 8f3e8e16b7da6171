"""Adapter: an orders / line-items star schema with an event log, seen as shop tables.

``style`` names items by their product name (few items, many repeat purchases),
``sku`` by part key (many items).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from rebuy.session import source_bytes, source_version, spread_by_size
from rebuy.sources.tables import ShopTables, shop_tables

LAST_EVENT_DAY = date(2024, 1, 31)

# Columns read from the star schema; stated, so that no job infers them.
COLUMNS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double",
    "events": "ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def event_shift_days(cutoff: str) -> int:
    """Days by which the event log is moved so that it ends at the cutoff."""
    return (LAST_EVENT_DAY - date.fromisoformat(cutoff)).days


def star_tables(spark: SparkSession, folder: str, cutoff: str, variant: str = "sku") -> ShopTables:
    def table(name: str) -> DataFrame:
        return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")

    part = table("part").withColumn("sku", F.col("p_partkey").cast("string"))
    lines = (
        table("lineitem")
        .join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    log = table("events").withColumn("sku", F.get_json_object("props", "$.k"))
    words = F.split("p_name", " ")
    if variant == "style":
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("item_id", F.col("p_name"))
        log = log.join(part.select("sku", "p_name"), "sku").withColumn("item_id", F.col("p_name"))
        items = (
            part.groupBy("p_name")
            .agg(F.sum(F.col("p_retailprice").cast("decimal(18,6)")).alias("total"), F.count("*").alias("n"))
            .select(
                F.col("p_name").alias("item_id"),
                F.lit(None).cast("string").alias("category_l1"),
                words[0].alias("category_l2"),
                words[1].alias("category_l3"),
                words[0].alias("brand"),
                (F.col("total").cast("double") / F.col("n")).alias("price"),
            )
        )
    elif variant == "sku":
        lines = lines.withColumn("item_id", F.col("l_partkey").cast("string"))
        log = log.withColumn("item_id", F.col("sku"))
        items = part.select(
            F.col("sku").alias("item_id"),
            F.col("p_type").alias("category_l1"),
            words[0].alias("category_l2"),
            words[1].alias("category_l3"),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("price"),
        )
    else:
        raise ValueError(f"unknown variant {variant!r}")

    transactions = lines.select(
        F.col("o_custkey").alias("customer_id"),
        "item_id",
        F.col("o_orderkey").alias("bill_id"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("s_nationkey").cast("bigint").alias("location"),
        F.col("o_orderdate").alias("updated_date"),
    )
    kind = (
        F.when(F.col("event_type") == "view", "view_item")
        .when(F.col("event_type") == "click", "add_to_cart")
        .otherwise(F.col("event_type"))
    )
    shift = F.expr(f"INTERVAL '{event_shift_days(cutoff)}' DAY")
    events = log.select(
        F.col("user_id").alias("customer_id"),
        "item_id",
        kind.alias("event_type"),
        F.floor(F.col("value") / 50).cast("double").alias("quantity"),
        (F.col("ts") - shift).alias("event_date"),
    )
    paths = [f"{folder}/{name}.parquet" for name in COLUMNS]
    spread_by_size(spark, source_bytes(spark, *paths))
    version = source_version(spark, *paths)
    # Events are moved to the cutoff, so it is part of what the tables hold.
    return shop_tables(transactions, events, items, source_key=f"{version}#{variant}|{cutoff}")
