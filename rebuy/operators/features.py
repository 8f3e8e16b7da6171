"""Candidates and features of the second-stage ranker (relational part)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuy.functions.scoring import SCALE, WIDE, age_days, before, billionths, within, zero
from rebuy.operators.copurchase import adjacency, copurchase_neighbors
from rebuy.operators.customers import only_customers
from rebuy.operators.popularity import item_groups
from rebuy.operators.skew import heaviest, lookup_join
from rebuy.operators.topk import head, top_n
from rebuy.session import materialize, materialize_all
from rebuy.sources.tables import ShopTables

# Feature names, in training order.
FEATURES = [
    "user_txns",
    "user_items",
    "user_avg_price",
    "user_days_since_last",
    "user_txns_30d",
    "user_txns_90d",
    "user_velocity",
    "user_recency_x_freq",
    "item_txns",
    "item_buyers",
    "item_avg_price",
    "item_txns_7d",
    "item_txns_30d",
    "item_txns_90d",
    "item_trend_ratio",
    "item_penetration",
    "item_log_buyers",
    "ui_txns",
    "ui_qty",
    "ui_days_since_last",
    "purchase_share",
    "price_ratio",
    "ui_recency_x_freq",
    "event_views",
    "event_carts",
    "source_user_hist",
    "source_global",
    "source_group",
    "source_copurchase",
]
SOURCES = ["source_user_hist", "source_global", "source_group", "source_copurchase"]
GROUP_LEVELS = ("brand", "category_l3")
GROUPS_PER_LEVEL = 2
RANKER_BASKET_LIMIT = 12
NEVER = 9999.0


# Columns of the purchase profile that the customers' totals are made of.
OWN = ["n", "days", "price_sum", "price_n", "n_30d", "n_90d"]


@dataclass(frozen=True)
class CandidateConfig:
    user_candidates: int = 25
    global_candidates: int = 20
    group_candidates: int = 8
    copurchase_seeds: int = 4
    copurchase_neighbors: int = 10
    event_start: str = "2025-01-01"


def purchase_profile(transactions: DataFrame, cutoff: str) -> DataFrame:
    """One row per (customer, item) bought before the cutoff.

    The only pass over the transactions: customer, item and pair features and
    three of the four candidate sources are roll-ups of it. Prices and
    quantities are summed in whole billionths, so averages are reproducible.
    """
    old = transactions.filter(before(transactions, "updated_date", cutoff)).withColumn(
        "days", age_days("updated_date", cutoff).cast("double")
    )
    old = old.withColumn("price", billionths(F.col("price"))).withColumn("quantity", billionths(F.col("quantity")))
    one = F.lit(int(SCALE))
    at_least_one = F.when(F.col("quantity").isNotNull(), F.greatest("quantity", one))
    return old.groupBy("customer_id", "item_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("quantity").cast(WIDE)).alias("qty"),
        F.sum(at_least_one.cast(WIDE)).alias("qty_min1"),
        F.sum(F.col("price").cast(WIDE)).alias("price_sum"),
        F.count("price").alias("price_n"),
        F.max("updated_date").alias("last_date"),
        F.min("days").alias("days"),
        *[F.count_if(F.col("days") <= limit).alias(f"n_{limit}d") for limit in (7, 30, 90)],
    )


@dataclass(frozen=True)
class RankerInputs:
    """Shared tables of one cutoff: sampled customers, pair profile, item features."""

    tables: ShopTables
    cutoff: str
    customers: DataFrame
    profile: DataFrame
    items: DataFrame

    @property
    def own_profile(self) -> DataFrame:
        return only_customers(self.profile, self.customers)


def ranker_inputs(tables: ShopTables, cutoff: str, customers: DataFrame) -> RankerInputs:
    stored = materialize_all(
        {"ranker-customers": customers, "purchase-profile": purchase_profile(tables.transactions, cutoff)}
    )
    customers, profile = stored["ranker-customers"], stored["purchase-profile"]
    items = materialize(item_features(profile, customers), "item-features")
    return RankerInputs(tables, cutoff, customers, profile, items)


# --- features ------------------------------------------------------------------------------


def _counts(prefix: str, limits: tuple[int, ...]) -> list[Column]:
    return [F.sum(f"n_{limit}d").cast("double").alias(f"{prefix}_txns_{limit}d") for limit in limits]


def _average_price() -> Column:
    return F.try_divide(F.sum("price_sum").cast("double"), F.sum("price_n").cast("double")) / SCALE


def user_features(own_profile: DataFrame) -> DataFrame:
    totals = (
        own_profile.groupBy("customer_id")
        .agg(
            F.sum("n").cast("double").alias("user_txns"),
            F.count("*").cast("double").alias("user_items"),
            _average_price().alias("user_avg_price"),
            F.min("days").alias("user_days_since_last"),
            *_counts("user", (30, 90)),
        )
    )
    return with_rates(totals)


def with_rates(users: DataFrame) -> DataFrame:
    return users.withColumn("user_velocity", F.col("user_txns_30d") / (F.col("user_txns_90d") + 1.0)).withColumn(
        "user_recency_x_freq", F.col("user_txns") / (F.col("user_days_since_last") + 1.0)
    )


def item_features(profile: DataFrame, customers: DataFrame) -> DataFrame:
    """Buyers count all customers but are divided by the sampled ones, so penetration may exceed 1."""
    sampled = customers.agg(F.greatest(F.count("*"), F.lit(1)).cast("double")).scalar()
    return (
        profile.groupBy("item_id")
        .agg(
            F.sum("n").cast("double").alias("item_txns"),
            F.count("*").cast("double").alias("item_buyers"),
            _average_price().alias("item_avg_price"),
            *_counts("item", (7, 30, 90)),
        )
        .withColumn("item_trend_ratio", F.col("item_txns_30d") / (F.col("item_txns_90d") + 1.0))
        .withColumn("item_penetration", F.col("item_buyers") / sampled)
        .withColumn("item_log_buyers", F.ln(F.col("item_buyers") + 1.0))
    )


def pair_features(own_profile: DataFrame) -> DataFrame:
    return own_profile.select(
        "customer_id",
        "item_id",
        F.col("n").cast("double").alias("ui_txns"),
        (F.col("qty").cast("double") / SCALE).alias("ui_qty"),
        F.col("days").alias("ui_days_since_last"),
    )


def event_features(events: DataFrame, customers: DataFrame, start: str, cutoff: str) -> DataFrame:
    counted = (
        events.filter(within(events, "event_date", start, cutoff))
        .groupBy("customer_id", "item_id")
        .agg(
            F.count_if(F.col("event_type") == "view_item").cast("double").alias("event_views"),
            F.count_if(F.col("event_type") == "add_to_cart").cast("double").alias("event_carts"),
        )
    )
    return only_customers(counted, customers)


# --- candidates ----------------------------------------------------------------------------


def history_candidates(own_profile: DataFrame, n: int) -> DataFrame:
    """Best items per customer by ``2 * purchases + ln(quantity)``, then recency."""
    volume = F.coalesce(F.ln(F.col("qty_min1").cast("double") / SCALE), F.lit(-1e6))
    scored = own_profile.select(
        "customer_id", "item_id", "last_date", billionths(F.col("n") * 2.0 + volume).alias("score")
    )
    order = [F.desc("score"), F.desc("last_date"), F.col("item_id")]
    return top_n(scored, ["customer_id"], order, n).select("customer_id", "item_id", "score", "rnk")


def global_candidates(customers: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Every customer with the ``n`` items of most purchase rows (a bounded list, expanded in place)."""
    best = head(items.select("item_id", "item_txns"), [F.desc("item_txns"), F.col("item_id")], n)
    listed = best.agg(F.collect_list("item_id")).scalar()
    return customers.select("customer_id", F.explode(listed).alias("item_id"))


def candidate_groups(metadata: DataFrame) -> DataFrame:
    return item_groups(metadata, ",".join(GROUP_LEVELS))


def group_sets(groups: DataFrame) -> DataFrame:
    """The groups of each item; two brands and two levels of categories at most, if metadata has a row per item."""
    return groups.groupBy("item_id").agg(F.collect_set("grp").alias("grps"))


def group_lists(items: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """The ``n`` items of most purchase rows per group, and the buyers of the whole group."""
    weighted = items.select("item_id", "item_txns", "item_buyers").join(groups, "item_id")
    tops = top_n(weighted, ["grp"], [F.desc("item_txns"), F.col("item_id")], n)
    lists = tops.groupBy("grp").agg(F.collect_list("item_id").alias("best"))
    return lists.join(weighted.groupBy("grp").agg(F.sum("item_buyers").alias("buyers")), "grp")


def group_candidates(history: DataFrame, items: DataFrame, grouped: DataFrame, lists: DataFrame) -> DataFrame:
    """Top items of the two brands and two category_l3 that most of the history candidates share.

    ``grouped`` (the groups of each item) and ``lists`` are stored tables; their sizes decide how they are joined.
    """
    member = lookup_join(
        history.select("customer_id", "item_id"), grouped, "item_id", lambda: heaviest(items, "item_id", "item_buyers"), "customer_id"
    )
    liked = (
        member.select("customer_id", F.explode("grps").alias("grp"))
        .groupBy("customer_id", "grp")
        .agg(F.count("*").alias("n"))
        .withColumn("level", F.substring_index("grp", ":", 1))
    )
    chosen = top_n(liked, ["customer_id", "level"], [F.desc("n"), F.col("grp")], GROUPS_PER_LEVEL)
    met = lookup_join(
        chosen.select("customer_id", "grp"), lists, "grp", lambda: heaviest(lists, "grp", "buyers"), "customer_id"
    )
    return met.select("customer_id", F.explode("best").alias("item_id"))


def copurchase_candidates(history: DataFrame, near: DataFrame, items: DataFrame, seeds: int) -> DataFrame:
    first = history.filter(F.col("rnk") <= seeds).select("customer_id", "item_id")
    met = lookup_join(first, near, "item_id", lambda: heaviest(items, "item_id", "item_buyers"), "customer_id")
    return met.select("customer_id", F.explode("near.neighbor_id").alias("item_id"))


def stack_candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of the sources with one flag per source; a pair has a row for each source that offers it."""
    stacked = None
    for name, frame in sources.items():
        flags = [F.lit(1.0 if other == name else 0.0).alias(other) for other in SOURCES]
        flagged = frame.select("customer_id", "item_id", *flags)
        stacked = flagged if stacked is None else stacked.unionByName(flagged)
    return stacked


def merge_candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """One row per pair with one 0/1 flag per source."""
    return stack_candidates(sources).groupBy("customer_id", "item_id").agg(*[F.max(name).alias(name) for name in SOURCES])


def candidate_sources(inputs: RankerInputs, cfg: CandidateConfig) -> dict[str, DataFrame]:
    tables = inputs.tables
    groups = candidate_groups(tables.items)
    neighbors = copurchase_neighbors(tables.transactions, inputs.cutoff, RANKER_BASKET_LIMIT, cfg.copurchase_neighbors)
    stored = materialize_all(
        {
            "near": adjacency(neighbors),
            "group-lists": group_lists(inputs.items, groups, cfg.group_candidates),
            "group-sets": group_sets(groups),
            "history-candidates": history_candidates(inputs.own_profile, cfg.user_candidates),
        }
    )
    history = stored["history-candidates"]
    return {
        "source_user_hist": history,
        "source_global": global_candidates(inputs.customers, inputs.items, cfg.global_candidates),
        "source_group": group_candidates(history, inputs.items, stored["group-sets"], stored["group-lists"]),
        "source_copurchase": copurchase_candidates(history, stored["near"], inputs.items, cfg.copurchase_seeds),
    }


def build_candidates(inputs: RankerInputs, cfg: CandidateConfig) -> DataFrame:
    return merge_candidates(candidate_sources(inputs, cfg))


def candidate_rows(inputs: RankerInputs, cfg: CandidateConfig) -> DataFrame:
    """The candidates before they are merged, for ``feature_frame``, which merges them itself."""
    return stack_candidates(candidate_sources(inputs, cfg))


def feature_frame(inputs: RankerInputs, candidates: DataFrame, end: str, cfg: CandidateConfig) -> DataFrame:
    """Candidates with label and features: (customer_id, item_id, label, *FEATURES).

    Candidates (one row per pair, or one per source), purchases of the label window, the customers'
    own purchase profile and their events are stacked and moved once, by customer. Grouping
    by pair and the customers' totals (windows) follow in the same partitions. Popular items
    are candidates of every customer, hence the spread join on the item side.
    """
    tables = inputs.tables
    bought = tables.transactions.filter(within(tables.transactions, "updated_date", inputs.cutoff, end)).filter("item_id is not null")
    seen = tables.events.filter(within(tables.events, "event_date", cfg.event_start, inputs.cutoff)).filter("item_id is not null")
    # Pairs without an item match nothing, but count in the customer's totals.
    paired = F.col("item_id").isNotNull()
    parts = [
        candidates.select("customer_id", "item_id", *SOURCES, F.lit(1).alias("offered")),
        only_customers(bought.select("customer_id", "item_id", F.lit(1).alias("label")), inputs.customers),
        inputs.own_profile.select(
            "customer_id",
            "item_id",
            *OWN,
            F.when(paired, F.col("n").cast("double")).alias("ui_txns"),
            F.when(paired, F.col("qty").cast("double") / SCALE).alias("ui_qty"),
            F.when(paired, F.col("days")).alias("ui_days_since_last"),
        ),
        only_customers(
            seen.select(
                "customer_id",
                "item_id",
                (F.col("event_type") == "view_item").cast("double").alias("event_views"),
                (F.col("event_type") == "add_to_cart").cast("double").alias("event_carts"),
            ),
            inputs.customers,
        ),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    once = ["offered", "label", *SOURCES, *OWN, "ui_txns", "ui_qty", "ui_days_since_last"]
    pairs = stacked.repartition("customer_id").groupBy("customer_id", "item_id").agg(
        *[F.max(name).alias(name) for name in once], *[F.sum(name).alias(name) for name in ("event_views", "event_carts")]
    )
    own = Window.partitionBy("customer_id")
    totals = {
        "user_txns": F.sum("n").over(own).cast("double"),
        "user_items": F.count("n").over(own).cast("double"),
        "user_avg_price": F.try_divide(F.sum("price_sum").over(own).cast("double"), F.sum("price_n").over(own).cast("double")) / SCALE,
        "user_days_since_last": F.min("days").over(own),
        "user_txns_30d": F.sum("n_30d").over(own).cast("double"),
        "user_txns_90d": F.sum("n_90d").over(own).cast("double"),
    }
    joined = with_rates(pairs.withColumns(totals).filter("offered = 1").drop("offered", *OWN))
    prices = tables.items.groupBy("item_id").agg(F.max("price").alias("meta_price"))
    item_side = materialize(inputs.items.join(prices, "item_id", "full"), "item-side")
    joined = lookup_join(
        joined, item_side, "item_id", lambda: heaviest(inputs.items, "item_id", "item_buyers"), "customer_id", "left"
    )

    meta_price = F.col("meta_price")
    defaults = {
        "user_avg_price": F.coalesce("user_avg_price", meta_price, F.lit(0.0)),
        "item_avg_price": F.coalesce("item_avg_price", meta_price, F.lit(0.0)),
        "user_days_since_last": F.coalesce("user_days_since_last", F.lit(NEVER)),
        "ui_days_since_last": F.coalesce("ui_days_since_last", F.lit(NEVER)),
    }
    derived = ("purchase_share", "price_ratio", "ui_recency_x_freq")
    filled = joined.select(
        "customer_id",
        "item_id",
        F.coalesce("label", F.lit(0)).alias("label"),
        *[defaults.get(name, zero(name)).alias(name) for name in FEATURES if name not in derived],
    )
    return (
        filled.withColumn("purchase_share", F.col("ui_txns") / (F.col("user_txns") + 1.0))
        .withColumn("price_ratio", F.col("item_avg_price") / (F.col("user_avg_price") + 1.0))
        .withColumn("ui_recency_x_freq", F.col("ui_txns") / (F.col("ui_days_since_last") + 1.0))
        .select("customer_id", "item_id", "label", *FEATURES)
    )


def with_positives(frame: DataFrame) -> DataFrame:
    """Rows of the customers that have at least one positive label (for training only)."""
    positive = frame.groupBy("customer_id").agg(F.sum("label").alias("positives")).filter("positives > 0")
    return frame.join(positive.select("customer_id"), "customer_id", "left_semi")


def label_report(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("positives"))
