"""The hybrid recommender: repeat, co-purchase, group, location and global evidence in one ranking.

The score is linear in the weights, so evidence is collected once per
(customer, item) and any number of weight settings is then ranked from the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuy.config import HybridConfig
from rebuy.functions.scoring import SHARE, shares, zero
from rebuy.operators import skew
from rebuy.operators.copurchase import adjacency, cached_neighbors
from rebuy.operators.customers import target_customers, truth
from rebuy.operators.metrics import ranking_metrics, segmented_metrics
from rebuy.operators.popularity import (
    global_scores,
    group_top_items,
    item_groups,
    item_totals,
    location_top_items,
    user_location,
)
from rebuy.operators.signals import customer_items, train_signals, user_history
from rebuy.operators.skew import heaviest, lookup_join, spread_join, stored_bytes
from rebuy.session import in_background, materialize, materialize_all
from rebuy.sources.tables import ShopTables


@dataclass(frozen=True)
class Weights:
    name: str
    repeat: float
    copurchase: float
    category: float
    location: float
    glob: float

    @staticmethod
    def of(cfg: HybridConfig, name: str = "hybrid") -> "Weights":
        return Weights(
            name,
            cfg.repeat_weight,
            cfg.copurchase_weight,
            cfg.category_weight,
            cfg.location_weight,
            cfg.global_weight,
        )


@dataclass(frozen=True)
class Training:
    """What is learnt from the rows before the cutoff, whoever is recommended to.

    All tables are stored: they have several consumers, and their sizes decide
    how they are joined. The lookups of unused stages are None.
    """

    pairs: DataFrame
    totals: DataFrame
    popular: DataFrame
    near: DataFrame | None
    item_groups: DataFrame | None
    group_best: DataFrame | None

    @property
    def seen(self) -> DataFrame:
        return self.pairs.select("customer_id").distinct()

    def hot_items(self) -> DataFrame:
        return heaviest(self.totals, "item_id", "customers")

    def hot_groups(self) -> DataFrame:
        members = self.totals.join(self.item_groups, "item_id").select(F.explode("grps").alias("grp"), "customers")
        return heaviest(members.groupBy("grp").agg(F.sum("customers").alias("customers")), "grp", "customers")


def train(tables: ShopTables, cfg: HybridConfig, near: DataFrame | None = None, pairs: DataFrame | None = None) -> Training:
    """Aggregate signals and baskets once; the two sides run at the same time.

    ``near`` is a neighbour lookup learnt earlier for the same cutoff, ``pairs`` the
    customer-item totals if they need not be made from the signals.
    """
    baskets = None
    if cfg.copurchase_weight and near is None:
        baskets = in_background(tables.spark, lambda: materialize(neighbor_lookup(tables, cfg), "near"))
    first = {"customer-items": customer_items(train_signals(tables, cfg)) if pairs is None else pairs}
    groups = None
    if cfg.category_weight:
        groups = item_groups(tables.items, cfg.category_level)
        first["item-groups"] = groups.groupBy("item_id").agg(F.collect_set("grp").alias("grps"))
    stored = materialize_all(first)
    totals = materialize(item_totals(stored["customer-items"]), "item-totals")
    second = {"popular": global_scores(totals, cfg.global_limit)}
    if groups is not None:
        grouped = stored["item-groups"].select("item_id", F.explode("grps").alias("grp"))
        tops = group_top_items(totals, grouped, cfg.max_category_items)
        second["group-best"] = tops.groupBy("grp").agg(F.collect_list(F.struct("item_id", "score")).alias("best"))
    stored.update(materialize_all(second))
    return Training(
        stored["customer-items"],
        totals,
        stored["popular"],
        near if baskets is None else baskets.result(),
        stored.get("item-groups"),
        stored.get("group-best"),
    )


def neighbor_lookup(tables: ShopTables, cfg: HybridConfig) -> DataFrame:
    """From the neighbour table of this source and cutoff, which is made only once."""
    return adjacency(cached_neighbors(tables, cfg))


# Kinds of evidence.
REPEAT, COPURCHASE, CATEGORY, LOCATION = range(4)
# History rows grow into many evidence rows, so they are laid out in more partitions.
GROWTH = 2


@dataclass(frozen=True)
class EvidenceLists:
    """Item lists by key: neighbours of an item, best items of a group or a location.

    Two tables of bounded lists, each reached by one join: those that every executor can hold
    (their union is broadcast), and the others, whose rows must move to the lists.
    """

    at_hand: DataFrame | None
    spread: DataFrame | None
    hot_keys: Callable[[], DataFrame]
    spread_kinds: tuple[int, ...]
    homes: DataFrame | None


def evidence_lists(tables: ShopTables, cfg: HybridConfig, targets: DataFrame, training: Training) -> EvidenceLists:
    """The lists of the stages with a weight; the others are left out."""
    parts: list[tuple[int, DataFrame]] = []
    hot: dict[int, Callable[[], DataFrame]] = {}
    homes = None

    def item_key() -> Column:
        return F.concat(F.lit("item:"), F.col("item_id")).alias("key")

    if cfg.copurchase_weight:
        entries = F.transform("near", lambda x: F.struct(x["neighbor_id"].alias("item_id"), x["score"].alias("score")))
        parts.append((COPURCHASE, training.near.select(item_key(), entries.alias("entries"))))
        hot[COPURCHASE] = lambda: training.hot_items().select(item_key(), "copies")
    if cfg.category_weight:
        parts.append((CATEGORY, training.group_best.select(F.col("grp").alias("key"), F.col("best").alias("entries"))))
        hot[CATEGORY] = lambda: training.hot_groups().select(F.col("grp").alias("key"), "copies")
    if cfg.location_weight:
        tops = location_top_items(tables.transactions, cfg)
        key = F.concat(F.lit("location:"), F.col("location").cast("string")).alias("key")
        stored = materialize_all(
            {
                "homes": user_location(tables.transactions, cfg.cutoff, targets).select("customer_id", key),
                "location-best": tops.groupBy(key).agg(F.collect_list(F.struct("item_id", "score")).alias("entries")),
            }
        )
        homes = stored["homes"]
        parts.append((LOCATION, stored["location-best"]))
        hot[LOCATION] = lambda: heaviest(homes.groupBy("key").agg(F.count("*").alias("n")), "key", "n")
    at_hand: list[DataFrame] = []
    spread: dict[int, DataFrame] = {}
    room = skew.BROADCAST_BYTES
    for kind, lists in sorted(parts, key=lambda part: stored_bytes(part[1])):
        room -= stored_bytes(lists)
        if room >= 0:
            at_hand.append(lists)
        else:
            spread[kind] = lists

    def hot_keys() -> DataFrame:
        return reduce(DataFrame.unionByName, [hot[kind]() for kind in spread])

    def union(frames) -> DataFrame | None:
        return reduce(DataFrame.unionByName, frames) if frames else None

    return EvidenceLists(union(at_hand), union(list(spread.values())), hot_keys, tuple(spread), homes)


def target_history(pairs: DataFrame, targets: DataFrame, homes: DataFrame | None, cfg: HybridConfig) -> DataFrame:
    """History of every target; one row without an item where there is none.

    ``floor`` is the score of the k-th history item, ``home`` the key of the
    customer's location list.
    """
    lead = targets.select("customer_id")
    if homes is None:
        lead = lead.withColumn("home", F.lit(None).cast("string"))
    else:
        lead = lead.join(homes.withColumnRenamed("key", "home"), "customer_id", "left")
    whole = Window.partitionBy("customer_id").orderBy("rnk").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    history = user_history(pairs, cfg.max_user_items, targets)
    history = history.withColumn("floor", F.nth_value("score", cfg.k).over(whole))
    return lead.join(history, "customer_id", "left")


def _fresh_groups(history: DataFrame, training: Training, cfg: HybridConfig) -> DataFrame:
    """Adds the groups of each seed that no better-ranked seed of the customer belongs to."""
    met = lookup_join(history, training.item_groups, "item_id", training.hot_items, "customer_id", "left")
    met = met.withColumn("grps", F.when(F.col("rnk") <= cfg.max_seeds, F.col("grps")))
    better = Window.partitionBy("customer_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("fresh", F.array_except("grps", F.flatten(F.collect_list("grps").over(better))))


def collect_evidence(tables: ShopTables, cfg: HybridConfig, targets: DataFrame, training: Training) -> DataFrame:
    """One row per (target, candidate item) with its evidence by kind.

    ``targets`` are distinct. Each history row asks for itself and for the
    lists it gives evidence through; one join fetches them all. A group counts
    once per customer, from its best-ranked seed. The history is laid out by
    customer first, a fraction of the rows it grows into; with broadcast lists
    nothing moves after that. Lists that are too large for that come back to the customer
    whole, a row per list, and are expanded there, next to those at hand. What one customer can gather is bounded by the
    settings. ``floor`` is used by :func:`rank_lists`.
    """
    wanted = evidence_lists(tables, cfg, targets, training)
    partitions = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = target_history(training.pairs, targets, wanted.homes, cfg).repartition(GROWTH * partitions, "customer_id")
    none = F.array().cast("array<struct<kind:int,key:string>>")

    def ask(kind: int | Column, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    asked = {REPEAT: F.array(ask(REPEAT, F.lit(None).cast("string")))}
    if cfg.copurchase_weight:
        seed = F.col("rnk").between(1, cfg.max_seeds)
        asked[COPURCHASE] = F.when(seed, F.array(ask(COPURCHASE, F.concat(F.lit("item:"), F.col("item_id")))))
    if cfg.category_weight:
        rows = _fresh_groups(rows, training, cfg)
        asked[CATEGORY] = F.transform("fresh", lambda grp: ask(CATEGORY, grp))
    if wanted.homes is not None:
        first = F.coalesce(F.col("rnk"), F.lit(1)) == 1
        asked[LOCATION] = F.when(first & F.col("home").isNotNull(), F.array(ask(LOCATION, F.col("home"))))

    def asks(kinds: Sequence[int]) -> Column:
        return F.concat(*[F.coalesce(asked[kind], none) for kind in kinds])

    carried = ["customer_id", "item_id", "score", "floor"]
    near = rows.select(*carried, asks([kind for kind in asked if kind not in wanted.spread_kinds]).alias("asked"))
    if wanted.spread is not None:
        # Ids and scores apart, which packs better than pairs of them.
        apart = wanted.spread.select("key", F.col("entries.item_id").alias("ids"), F.col("entries.score").alias("scores"))
        far = rows.select(*carried, F.inline(asks(wanted.spread_kinds)))
        met = spread_join(far, apart, "key", wanted.hot_keys(), "customer_id")
        answered = F.array(ask(F.col("kind"), F.lit(None).cast("string")))
        met = met.select("customer_id", "score", "floor", answered.alias("asked"), "ids", "scores")
        near = near.unionByName(met, allowMissingColumns=True).repartition("customer_id")
    rows = near.select("*", F.inline("asked"))
    entries = F.array(F.struct("item_id", F.lit(1.0).alias("score")))
    if wanted.spread is not None:
        fetched = F.zip_with("ids", "scores", lambda item, score: F.struct(item.alias("item_id"), score.alias("score")))
        entries = F.when(F.col("kind").isin(*wanted.spread_kinds), fetched).otherwise(entries)
    if wanted.at_hand is not None:
        rows = rows.join(F.broadcast(wanted.at_hand), "key", "left")
        entries = F.when((F.col("kind") == REPEAT) | F.col("kind").isin(*wanted.spread_kinds), entries).otherwise(F.col("entries"))
    rows = rows.select(
        "customer_id",
        "kind",
        "floor",
        F.when(F.col("kind") == LOCATION, F.lit(1.0)).otherwise(F.col("score")).alias("weight"),
        F.inline(entries),
    )
    value = F.col("weight") * F.col("score")

    def total(kind: int, name: str) -> Column:
        # At most max_seeds (or one) shares of at most 1 each: bigint is wide enough.
        return (F.sum(F.when(F.col("kind") == kind, shares(value))) / SHARE).alias(name)

    return rows.groupBy("customer_id", "item_id").agg(
        F.max(F.when(F.col("kind") == REPEAT, value)).alias("repeat"),
        total(COPURCHASE, "copurchase"),
        total(CATEGORY, "category"),
        total(LOCATION, "location"),
        F.max("floor").alias("floor"),
    )


def rank_lists(evidence: DataFrame, popular: DataFrame, weights: Sequence[Weights], k: int) -> DataFrame:
    """Top ``k`` per customer and weight setting: (name, customer_id, item_id, rnk, score).

    Every popular item is a candidate of every customer, but only a few can
    matter: those the customer has evidence for (scored by a broadcast join,
    as the popularity list is bounded) and the first ``k`` others. So the
    list is not multiplied by the customers.

    ``floor`` spares most rows the sort: with weights of 0 or more, the first
    ``k`` history items already score at least the floor times the repeat
    weight, so no item below that can be among the first ``k``. It has to be
    collected for the same ``k`` (or a larger one).
    """
    shared = popular.select("item_id", F.col("score").alias("glob"), F.col("rnk").alias("glob_rnk"))
    rows = evidence.join(F.broadcast(shared), "item_id", "left")
    scores = [
        [F.lit(i + 1).alias("pos"), _score(w).alias("score"), _least_score(w).alias("least")] for i, w in enumerate(weights)
    ]
    # A single setting needs no expansion.
    chosen = scores[0] if len(scores) == 1 else [F.inline(F.array(*[F.struct(*entry) for entry in scores]))]
    rows = rows.select("customer_id", "item_id", "glob", "glob_rnk", *chosen)
    # A null score marks the target itself, or an item this setting has no evidence for.
    in_reach = F.col("least").isNull() | (F.col("score") >= F.col("least")) | F.col("glob_rnk").isNotNull()
    rows = rows.filter(F.col("item_id").isNull() | (F.col("score").isNotNull() & in_reach)).drop("least")

    window = Window.partitionBy("customer_id", "pos").orderBy(
        F.desc_nulls_last("score"), F.desc(zero("glob")), F.desc("item_id")
    )
    entry = F.struct("score", zero("glob").alias("glob"), "item_id")
    kept = rows.withColumn("place", F.row_number().over(window)).filter(
        (F.col("place") <= k) | F.col("glob_rnk").isNotNull() | F.col("item_id").isNull()
    )
    lists = kept.groupBy("customer_id", "pos").agg(
        F.collect_list(F.when(F.col("score").isNotNull() & (F.col("place") <= k), entry)).alias("own"),
        F.collect_list(F.when(F.col("glob_rnk").isNotNull(), F.col("item_id"))).alias("taken"),
    )
    names = F.array(*[F.lit(w.name) for w in weights])
    lists = lists.withColumn("popular", F.element_at(_popular_entries(shared, weights), F.col("pos")))
    unclaimed = F.filter(
        F.slice("popular", F.lit(1), F.lit(k) + F.size("taken")),
        lambda item: ~F.array_contains("taken", item["item_id"]),
    )
    merged = F.sort_array(F.concat("own", F.slice(unclaimed, 1, k)), asc=False)
    return lists.select("pos", "customer_id", F.posexplode(F.slice(merged, 1, k)).alias("place", "entry")).select(
        F.element_at(names, F.col("pos")).alias("name"),
        "customer_id",
        "entry.item_id",
        (F.col("place") + 1).cast("bigint").alias("rnk"),
        F.greatest(F.col("entry.score") / SHARE, F.lit(0.0)).alias("score"),
    )


def _score(w: Weights) -> Column:
    """Weighted evidence in SHARE units; null where no weighted stage offers the item."""
    offered = F.col("repeat").isNotNull()
    for part in ("copurchase", "category", "location"):
        if getattr(w, part):
            offered = offered | F.col(part).isNotNull()
    parts = ("repeat", "copurchase", "category", "location", "glob")
    terms = [F.lit(float(getattr(w, part))) * zero(part) for part in parts]
    return F.when(offered, shares(sum(terms[1:], terms[0])))


def _least_score(w: Weights) -> Column:
    """What the k-th entry scores at least, in SHARE units; null where nothing is known."""
    if min(w.repeat, w.copurchase, w.category, w.location, w.glob) < 0:
        return F.lit(None).cast("bigint")
    return shares(F.lit(float(w.repeat)) * F.col("floor"))


def _popular_entries(shared: DataFrame, weights: Sequence[Weights]) -> Column:
    """Per weight setting, the popularity list in final order (a bounded one-row subquery).

    Without any global score the list only backfills, in rank order, below
    everything else.
    """
    gathered = shared.agg(F.collect_list(F.struct("item_id", "glob", "glob_rnk")).alias("items"))

    def entries(weight: float) -> Column:
        return F.sort_array(
            F.transform(
                "items",
                lambda item: F.when(
                    item["glob"].isNotNull(),
                    F.struct(
                        shares(F.lit(float(weight)) * item["glob"]).alias("score"),
                        item["glob"].alias("glob"),
                        item["item_id"].alias("item_id"),
                    ),
                ).otherwise(
                    F.struct(
                        F.lit(-1).cast("bigint").alias("score"),
                        (-item["glob_rnk"]).cast("double").alias("glob"),
                        item["item_id"].alias("item_id"),
                    )
                ),
            ),
            asc=False,
        )

    return gathered.select(F.array(*[entries(w.glob) for w in weights])).scalar()


def recommend(
    tables: ShopTables,
    cfg: HybridConfig,
    mode: str = "validate",
    targets: DataFrame | None = None,
    training: Training | None = None,
) -> DataFrame:
    """Ranked recommendations: (customer_id, item_id, rnk, score), ``cfg.k`` per target."""
    if targets is None:
        targets = target_customers(tables, cfg, mode)
    if training is None:
        training = train(tables, cfg)
    evidence = collect_evidence(tables, cfg, targets, training)
    return rank_lists(evidence, training.popular, [Weights.of(cfg)], cfg.k).drop("name")


@dataclass(frozen=True)
class Validation:
    recommendations: DataFrame
    metrics: DataFrame

    def with_counts(self) -> DataFrame:
        """The metrics with the number of recommendation lists."""
        lists = self.recommendations.agg(F.count_distinct("customer_id")).scalar()
        return self.metrics.withColumn("recommendation_rows", lists)


def validate(tables: ShopTables, cfg: HybridConfig) -> Validation:
    """Recommend to the buyers of the validation window and measure by segment."""
    training = train(tables, cfg)
    recs = materialize(recommend(tables, cfg, training=training), "recommendations")
    bought = truth(tables.transactions, cfg.cutoff, cfg.valid_end)
    return Validation(recs, segmented_metrics(recs, bought, training.seen, cfg.k))


def overall_metrics(tables: ShopTables, cfg: HybridConfig) -> DataFrame:
    return ranking_metrics(recommend(tables, cfg), truth(tables.transactions, cfg.cutoff, cfg.valid_end), cfg.k)
