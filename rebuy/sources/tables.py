"""Input tables, their column contract, and the readers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rebuy.session import settle, source_bytes, source_version, spread_by_size

_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Column -> type; "time" accepts any timestamp or date column as it is stored.
TRANSACTIONS = {
    "customer_id": "bigint",
    "item_id": "string",
    "bill_id": "any",
    "quantity": "double",
    "price": "double",
    "location": "bigint",
    "updated_date": "time",
}
EVENTS = {
    "customer_id": "bigint",
    "item_id": "string",
    "event_type": "string",
    "quantity": "double",
    "event_date": "time",
}
ITEMS = {
    "item_id": "string",
    "category_l1": "string",
    "category_l2": "string",
    "category_l3": "string",
    "brand": "string",
    "price": "double",
}


@dataclass(frozen=True)
class ShopTables:
    transactions: DataFrame
    events: DataFrame
    items: DataFrame
    source_key: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.transactions.sparkSession


def conform(df: DataFrame, contract: dict[str, str], table: str) -> DataFrame:
    """Check the columns once on load and cast only those that differ."""
    missing = [name for name in contract if name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    columns = []
    for name, wanted in contract.items():
        found = df.schema[name].dataType
        if wanted == "time":
            if not isinstance(found, _TIME):
                raise ValueError(f"{table}.{name}: expected a timestamp or date, found {found.simpleString()}")
            columns.append(F.col(name))
        elif wanted == "any" or found.simpleString() == wanted:
            columns.append(F.col(name))
        else:
            columns.append(F.col(name).cast(wanted).alias(name))
    return df.select(*columns)


def shop_tables(transactions: DataFrame, events: DataFrame, items: DataFrame, source_key: str = "") -> ShopTables:
    settle(transactions.sparkSession)
    return ShopTables(
        conform(transactions, TRANSACTIONS, "transactions"),
        conform(events, EVENTS, "events"),
        conform(items, ITEMS, "items"),
        source_key,
    )


def read_shop_tables(spark: SparkSession, transactions: str, events: str, items: str) -> ShopTables:
    spread_by_size(spark, source_bytes(spark, transactions, events, items))
    return shop_tables(
        spark.read.parquet(transactions),
        spark.read.parquet(events),
        spark.read.parquet(items),
        source_key=source_version(spark, transactions, events, items),
    )


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Distinct target customers from Parquet (by suffix) or CSV with a header."""
    if path.lower().endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("customer_id").cast("bigint").alias("customer_id")).distinct()
