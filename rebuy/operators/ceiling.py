"""Upper bounds: how much of a window's purchases the history already contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuy.functions.scoring import before, ratio, within
from rebuy.sources.tables import ShopTables

SOURCES = ("repeat_purchase", "prior_event", "prior_any")


def target_overlap(tables: ShopTables, cutoff: str, valid_end: str, event_start: str = "2025-01-01") -> DataFrame:
    """Per buyer of the window: target size and overlap with earlier purchases and events.

    Every event type counts as history here, and no item id is dropped.
    Targets and history are stacked and grouped, so the item sets are never
    gathered into lists.
    """
    none = F.lit(0)

    def marked(df: DataFrame, target: Column, purchase: Column, event: Column) -> DataFrame:
        return df.select("customer_id", "item_id", target.alias("target"), purchase.alias("purchase"), event.alias("event"))

    tx, ev = tables.transactions, tables.events
    rows = (
        marked(tx.filter(within(tx, "updated_date", cutoff, valid_end)), F.lit(1), none, none)
        .unionByName(marked(tx.filter(before(tx, "updated_date", cutoff)), none, F.lit(1), none))
        .unionByName(marked(ev.filter(within(ev, "event_date", event_start, cutoff)), none, none, F.lit(1)))
    )
    items = rows.groupBy("customer_id", "item_id").agg(
        F.max("target").alias("target"), F.max("purchase").alias("purchase"), F.max("event").alias("event")
    )
    known = F.greatest("purchase", "event")
    return (
        items.groupBy("customer_id")
        .agg(
            F.sum("target").alias("target_n"),
            F.sum(F.col("target") * F.col("purchase")).alias("repeat_purchase"),
            F.sum(F.col("target") * F.col("event")).alias("prior_event"),
            F.sum(F.col("target") * known).alias("prior_any"),
            F.max(known).alias("seen"),
        )
        .filter("target_n > 0")
    )


def by_segment(overlap: DataFrame) -> DataFrame:
    kind = F.when(F.col("seen") == 1, F.lit("seen")).otherwise(F.lit("cold"))
    return overlap.withColumn("segment", F.explode(F.array(F.lit("all"), kind)))


def target_size_summary(segmented: DataFrame) -> DataFrame:
    """Size distribution of the target sets per segment.

    Quantiles are read off a histogram of the sizes (one row per distinct
    size), so customers are never sorted: the median interpolates, the upper
    quantiles take the nearest rank.
    """
    sizes = segmented.groupBy("segment", "target_n").agg(F.count("*").alias("customers"))
    growing = Window.partitionBy("segment").orderBy("target_n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("segment")
    ranked = sizes.withColumn("upto", F.sum("customers").over(growing)).withColumn("users", F.sum("customers").over(whole))
    last = F.col("users") - 1

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("target_n")))

    def nearest(q: float) -> Column:
        return at(F.round(F.lit(q) * last))

    users = F.sum("customers")
    items = F.sum(F.col("customers") * F.col("target_n"))
    return ranked.groupBy("segment").agg(
        users.alias("users"),
        items.alias("target_items"),
        ratio(items, users).alias("avg_target_items"),
        ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median_target_items"),
        nearest(0.75).cast("double").alias("p75_target_items"),
        nearest(0.90).cast("double").alias("p90_target_items"),
        nearest(0.99).cast("double").alias("p99_target_items"),
        F.sum(F.when(F.col("target_n") >= 2, F.col("customers")).otherwise(0)).alias("users_with_2plus_items"),
        F.sum(F.when(F.col("target_n") >= 3, F.col("customers")).otherwise(0)).alias("users_with_3plus_items"),
    )


def overlap_summary(segmented: DataFrame, k: int) -> DataFrame:
    """Recoverable hits per segment (all, seen) and history source.

    ``recoverable_precision`` is not capped at ``k`` items per customer;
    ``perfect_precision`` is.
    """
    entries = [F.struct(F.lit(name).alias("source"), F.col(name).alias("hits")) for name in SOURCES]
    rows = (
        segmented.filter(F.col("segment") != "cold")
        .select("segment", "target_n", F.explode(F.array(*entries)).alias("overlap"))
        .select("segment", "target_n", "overlap.source", "overlap.hits")
    )
    users = F.count("*")
    targets = F.sum("target_n")
    hits = F.sum("hits")
    helped = F.count_if(F.col("hits") > 0)
    perfect = F.sum(F.least(F.col("target_n"), F.lit(k)))
    return rows.groupBy("segment", "source").agg(
        users.alias("users"),
        targets.alias("target_items"),
        hits.alias("recoverable_hits"),
        helped.alias("users_with_any_recoverable"),
        perfect.alias("perfect_hits_at_k"),
        ratio(hits, users * k).alias("recoverable_precision"),
        ratio(hits, targets).alias("recoverable_recall"),
        ratio(perfect, users * k).alias("perfect_precision"),
        ratio(helped, users).alias("user_recoverable_rate"),
    )
