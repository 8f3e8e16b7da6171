"""Registered queries: every operator on the star-schema tables, whole tables each time."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from catalog import settings as S
from rebuy.operators import blending, boosting, ceiling, copurchase, customers, features, interactions, metrics, periods, popularity, signals
from rebuy.plans import experiments, hybrid, latent, ranker
from rebuy.session import materialize, shared_dir
from rebuy.sources import sinks, tables as readers
from rebuy.sources.star_schema import star_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def sku(spark: SparkSession, folder: str):
    return star_tables(spark, folder, S.CUTOFF, "sku")


def style(spark: SparkSession, folder: str):
    return star_tables(spark, folder, S.CUTOFF, "style")


def tidy(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to 6 decimals, integers to bigint; decimals (and ``exact`` columns) as they are, as doubles."""

    def column(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType) or field.name in exact:
            value = value.cast("double")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), 6)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            value = value.cast("bigint")
        return value.alias(field.name)

    return df.select(*[column(field) for field in df.schema.fields])


def scored(df: DataFrame) -> DataFrame:
    """Points shown as a score, and their logarithm, which tells old (small) ones apart."""
    columns: list[Column] = []
    for c in df.columns:
        if c == "points":
            columns += [F.col(c).cast("double").alias("score"), F.ln(c).alias("log_score")]
        else:
            columns.append(F.col(c))
    return tidy(df.select(*columns))


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "rebuy", f"{name}-{uuid.uuid4().hex}")


# --- signals and what is learnt from them ---------------------------------------------------


@query
def purchase_signals(spark, folder):
    t = sku(spark, folder)
    return scored(signals.purchase_signals(t.transactions, None, S.CUTOFF, S.CUTOFF, S.DEFAULT.half_life_days))


@query
def event_signals(spark, folder):
    t = sku(spark, folder)
    return scored(signals.event_signals(t.events, S.EVENT_START, S.CUTOFF, S.CUTOFF, S.DEFAULT.half_life_days))


@query
def train_signals(spark, folder):
    return scored(signals.train_signals(style(spark, folder), S.DEFAULT))


def _pairs(t, cfg=S.DEFAULT):
    return signals.customer_items(signals.train_signals(t, cfg))


@query
def customer_items(spark, folder):
    return scored(_pairs(sku(spark, folder)))


@query
def own_files_items(spark, folder):
    """The same from files of one's own: other column orders and types, and columns that nobody asked for."""
    t, path = sku(spark, folder), scratch(spark, "own-files")
    tx = t.transactions.withColumn("note", F.lit("x")).withColumn("quantity", F.col("quantity").cast("decimal(12,2)"))
    log = t.events.withColumn("points", F.lit(1)).withColumn("quantity", F.col("quantity").cast("int"))
    for frame, name in ((tx, "transactions"), (log, "events"), (t.items.withColumn("score", F.lit(0)), "items")):
        frame.select(*sorted(frame.columns)).write.parquet(f"{path}/{name}.parquet")
    return scored(_pairs(readers.read_shop_tables(spark, *(f"{path}/{name}.parquet" for name in ("transactions", "events", "items")))))


@query
def item_totals(spark, folder):
    return scored(popularity.item_totals(_pairs(sku(spark, folder))).drop("customers"))


@query
def global_popularity(spark, folder):
    totals = popularity.item_totals(_pairs(sku(spark, folder)))
    return scored(popularity.global_scores(totals, S.DEFAULT.global_limit).select("item_id", "points", "n", "rnk"))


@query
def global_scores(spark, folder):
    totals = popularity.item_totals(_pairs(style(spark, folder)))
    return tidy(popularity.global_scores(totals, S.DEFAULT.global_limit).select("item_id", "score", "rnk"))


@query
def user_history(spark, folder):
    return tidy(signals.user_history(_pairs(sku(spark, folder)), S.DEFAULT.max_user_items))


@query
def baskets(spark, folder):
    found = copurchase.baskets(sku(spark, folder).transactions, S.CUTOFF, S.DEFAULT.max_basket_items)
    return found.select("bill_id", F.size("items").cast("bigint").alias("n_items"), F.concat_ws(",", "items").alias("items"))


@query
def copurchase_neighbors(spark, folder):
    t = sku(spark, folder)
    return tidy(
        copurchase.copurchase_neighbors(t.transactions, S.CUTOFF, S.DEFAULT.max_basket_items, S.DEFAULT.max_neighbors)
    )


@query
def copurchase_neighbors_style(spark, folder):
    t = style(spark, folder)
    return tidy(copurchase.copurchase_neighbors(t.transactions, S.CUTOFF, S.DEFAULT.max_basket_items, 20))


@query
def neighbor_cache_roundtrip(spark, folder):
    t, place = sku(spark, folder), scratch(spark, "neighbor-cache")
    copurchase.cached_neighbors(t, S.DEFAULT, place)
    return tidy(copurchase.cached_neighbors(t, S.DEFAULT, place))


@query
def item_groups(spark, folder):
    return popularity.item_groups(sku(spark, folder).items, "category_l1,category_l2,category_l3,brand")


@query
def item_groups_unknown(spark, folder):
    return popularity.item_groups(style(spark, folder).items, "category_l1,brand")


@query
def group_top_items(spark, folder):
    t = sku(spark, folder)
    groups = popularity.item_groups(t.items, S.PRODUCTION.category_level)
    return tidy(popularity.group_top_items(popularity.item_totals(_pairs(t)), groups, S.PRODUCTION.max_category_items))


@query
def user_location(spark, folder):
    t = sku(spark, folder)
    return popularity.user_location(t.transactions, S.CUTOFF, customers.target_customers(t, S.DEFAULT))


@query
def location_top_items(spark, folder):
    return tidy(popularity.location_top_items(sku(spark, folder).transactions, S.DEFAULT))


def ranked(recs: DataFrame) -> DataFrame:
    return tidy(recs)


# --- customers and recommendations -------------------------------------------------------------


@query
def targets_validate(spark, folder):
    return customers.target_customers(sku(spark, folder), S.DEFAULT, "validate")


@query
def targets_predict(spark, folder):
    return customers.target_customers(sku(spark, folder), S.DEFAULT, "predict")


@query
def targets_file_roundtrip(spark, folder):
    t, path = sku(spark, folder), scratch(spark, "targets") + ".csv"
    sinks.write_targets(customers.target_customers(t, S.DEFAULT), path)
    return readers.read_targets(spark, path)


@query
def hybrid_recs(spark, folder):
    return ranked(hybrid.recommend(sku(spark, folder), S.PRODUCTION))


@query
def hybrid_recs_default(spark, folder):
    return ranked(hybrid.recommend(style(spark, folder), S.DEFAULT))


@query
def hybrid_recs_location(spark, folder):
    return ranked(hybrid.recommend(sku(spark, folder), S.WITH_LOCATION))


@query
def hybrid_recs_predict(spark, folder):
    return ranked(hybrid.recommend(sku(spark, folder), S.PRODUCTION, mode="predict"))


@query
def hybrid_recs_repeat_only(spark, folder):
    cfg = S.DEFAULT.with_(copurchase_weight=0.0, global_weight=0.0, include_events=False)
    return ranked(hybrid.recommend(style(spark, folder), cfg))


@query
def hybrid_lists(spark, folder):
    path = scratch(spark, "lists")
    sinks.write_lists(hybrid.recommend(style(spark, folder), S.PRODUCTION), path, "json")
    lists = sinks.to_lists(sinks.read_lists(spark, path, "json"))
    return lists.select("customer_id", F.concat_ws("|", "items").alias("items"))


@query
def truth(spark, folder):
    return customers.truth(sku(spark, folder).transactions, S.CUTOFF, S.VALID_END)


@query
def ranking_metrics(spark, folder):
    return tidy(hybrid.overall_metrics(style(spark, folder), S.PRODUCTION))


@query
def customer_metrics(spark, folder):
    t = style(spark, folder)
    recs = hybrid.recommend(t, S.PRODUCTION)
    return tidy(metrics.per_customer(recs, customers.truth(t.transactions, S.CUTOFF, S.VALID_END), 10).drop("seen"))


@query
def metrics_by_segment(spark, folder):
    return tidy(hybrid.validate(style(spark, folder), S.PRODUCTION).metrics)


@query
def metrics_sink(spark, folder):
    path = scratch(spark, "metrics")
    sinks.write_metrics(hybrid.validate(style(spark, folder), S.PRODUCTION).with_counts(), path, S.PRODUCTION)
    stored = sinks.read_metrics(spark, path)
    columns = "segment users_evaluated total_correct map_at_k cutoff category_level k recommendation_rows".split()
    return tidy(stored.select(*columns))


@query
def cold_customers(spark, folder):
    t = sku(spark, folder)
    return customers.target_customers(t, S.DEFAULT).join(_pairs(t).select("customer_id"), "customer_id", "left_anti")


# --- ceilings ----------------------------------------------------------------------------------


def _segmented(spark, folder):
    return ceiling.by_segment(ceiling.target_overlap(style(spark, folder), S.CUTOFF, S.VALID_END, S.EVENT_START))


@query
def target_overlap(spark, folder):
    return tidy(ceiling.target_overlap(style(spark, folder), S.CUTOFF, S.VALID_END, S.EVENT_START))


@query
def target_size_summary(spark, folder):
    return tidy(ceiling.target_size_summary(_segmented(spark, folder)))


@query
def ceiling_overlap(spark, folder):
    return tidy(ceiling.overlap_summary(_segmented(spark, folder), 10))


# --- ranker candidates and features ---------------------------------------------------------------


CANDIDATES = features.CandidateConfig(event_start=S.EVENT_START)
# Quotients of exact sums: shown unrounded, as they often end in a 5 just after the sixth digit.
AVERAGES = ("user_avg_price", "item_avg_price")


def _inputs(spark, folder, cutoff=S.CUTOFF, end=S.VALID_END):
    t = style(spark, folder)
    users = customers.buyers(t.transactions, cutoff, end)
    return features.ranker_inputs(t, cutoff, users)


def _frame(spark, folder, cutoff=S.CUTOFF, end=S.VALID_END):
    inputs = _inputs(spark, folder, cutoff, end)
    return inputs, features.feature_frame(inputs, features.candidate_rows(inputs, CANDIDATES), end, CANDIDATES)


@query
def sample_users(spark, folder):
    return customers.sample_customers(sku(spark, folder).transactions, S.CUTOFF, S.VALID_END, S.SAMPLE_SIZE, S.SEED)


@query
def cand_user_history(spark, folder):
    found = features.history_candidates(_inputs(spark, folder).own_profile, CANDIDATES.user_candidates)
    return tidy(found.select("customer_id", "item_id", "rnk"))


@query
def cand_global(spark, folder):
    inputs = _inputs(spark, folder)
    return features.global_candidates(inputs.customers, inputs.items, CANDIDATES.global_candidates)


@query
def cand_group(spark, folder):
    inputs = _inputs(spark, folder)
    history = features.history_candidates(inputs.own_profile, CANDIDATES.user_candidates)
    groups = features.candidate_groups(inputs.tables.items)
    lists = materialize(features.group_lists(inputs.items, groups, CANDIDATES.group_candidates), "group-lists")
    sets = materialize(features.group_sets(groups), "group-sets")
    return features.group_candidates(history, inputs.items, sets, lists).distinct()


@query
def cand_copurchase(spark, folder):
    inputs = _inputs(spark, folder)
    history = features.history_candidates(inputs.own_profile, CANDIDATES.user_candidates)
    neighbors = copurchase.copurchase_neighbors(inputs.tables.transactions, S.CUTOFF, 12, CANDIDATES.copurchase_neighbors)
    near = copurchase.adjacency(neighbors)
    return features.copurchase_candidates(history, near, inputs.items, CANDIDATES.copurchase_seeds).distinct()


@query
def cand_merged(spark, folder):
    return tidy(features.build_candidates(_inputs(spark, folder), CANDIDATES))


@query
def feat_user(spark, folder):
    return tidy(features.user_features(_inputs(spark, folder).own_profile), exact=AVERAGES)


@query
def feat_item(spark, folder):
    return tidy(_inputs(spark, folder).items, exact=AVERAGES)


@query
def feat_user_item(spark, folder):
    return tidy(features.pair_features(_inputs(spark, folder).own_profile))


@query
def feat_event(spark, folder):
    inputs = _inputs(spark, folder)
    return tidy(features.event_features(inputs.tables.events, inputs.customers, S.EVENT_START, S.CUTOFF))


@query
def feature_frame(spark, folder):
    return tidy(_frame(spark, folder)[1], exact=AVERAGES)


@query
def train_positive_groups(spark, folder):
    frame = _frame(spark, folder, S.TRAIN_CUTOFF, S.TRAIN_END)[1]
    return tidy(features.with_positives(frame).select("customer_id", "item_id", "label"))


@query
def candidate_recall(spark, folder):
    inputs = _inputs(spark, folder)
    found = features.build_candidates(inputs, CANDIDATES)
    wanted = customers.truth(inputs.tables.transactions, S.CUTOFF, S.VALID_END, inputs.customers)
    return tidy(metrics.candidate_recall(found, wanted, 10))


@query
def label_report(spark, folder):
    return tidy(features.label_report(_frame(spark, folder)[1]))


# --- latent factors and blends ---------------------------------------------------------------------


def _heads(t):
    return interactions.head_items(t.transactions, S.CUTOFF, S.HEADS)


@query
def head_items(spark, folder):
    return tidy(_heads(sku(spark, folder)))


@query
def interaction_matrix(spark, folder):
    t = sku(spark, folder)
    pairs = interactions.interactions(
        t, S.CUTOFF, customers.target_customers(t, S.DEFAULT), _heads(t), event_start=S.EVENT_START
    )
    return tidy(interactions.interaction_matrix(pairs))


@query
def positive_pairs(spark, folder):
    t = sku(spark, folder)
    return tidy(
        interactions.positive_pairs(t.transactions, S.CUTOFF, customers.target_customers(t, S.DEFAULT), _heads(t))
    )


def _blend_lists(spark, folder):
    """Base and model list: two weightings of the same evidence."""
    t = style(spark, folder)
    targets = customers.target_customers(t, S.BLEND_BASE)
    training = hybrid.train(t, S.BLEND_BASE)
    lists = [hybrid.recommend(t, cfg, targets=targets, training=training) for cfg in (S.BLEND_BASE, S.BLEND_MODEL)]
    return lists[0], lists[1], customers.truth(t.transactions, S.CUTOFF, S.VALID_END)


def _blended(spark, folder, variants):
    base, model, wanted = _blend_lists(spark, folder)
    return blending.blend(blending.paired_ranks(base, model, wanted), variants, 10)


@query
def blend_rrf(spark, folder):
    return _blended(spark, folder, {f"w{weight:g}": blending.reciprocal_rank_key(weight) for weight in blending.BLEND_WEIGHTS})


@query
def blend_keep_base(spark, folder):
    return _blended(spark, folder, {f"keep{keep}": blending.keep_base_key(keep) for keep in blending.KEEP_LENGTHS})


@query
def blend_oracle(spark, folder):
    return _blended(spark, folder, {"oracle": blending.oracle_key()}).drop("variant")


@query
def blend_metrics(spark, folder):
    base, model, wanted = _blend_lists(spark, folder)
    return tidy(blending.blend_metrics(base, model, wanted, blending.standard_variants("model"), 10))


# --- experiment grid ----------------------------------------------------------------------------------


def _grid(spark, folder):
    splits = [experiments.Split(*split) for split in S.SPLITS]
    return experiments.run_grid(style(spark, folder), S.GRID_BASE, splits)


CUTOFFS = [split[1] for split in S.SPLITS]


def _at_every_cutoff(frames):
    stacked = None
    for cutoff, frame in frames.items():
        rows = frame.withColumn("cutoff", F.lit(cutoff))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked


@query
def split_customer_items(spark, folder):
    t = sku(spark, folder)
    found = periods.kept_signal_periods(t, CUTOFFS, S.GRID_BASE)
    h = S.GRID_BASE.half_life_days
    return scored(_at_every_cutoff({c: periods.customer_items_at(found, CUTOFFS, c, h) for c in CUTOFFS}))


@query
def split_neighbors(spark, folder):
    t, cfg = sku(spark, folder), S.GRID_BASE
    found = periods.kept_basket_periods(t, CUTOFFS, cfg)
    return tidy(periods.neighbors_at(found, CUTOFFS, CUTOFFS, cfg.max_basket_items, 5))


@query
def rolling_summary(spark, folder):
    return tidy(_grid(spark, folder))


@query
def rolling_config_means(spark, folder):
    return tidy(experiments.config_means(_grid(spark, folder)))


@query
def rolling_subset(spark, folder):
    splits = [experiments.Split(*split) for split in S.SPLITS[-1:]]
    configs = experiments.named(experiments.CONFIGS, ["baseline_hl60", "brand_l3_hl60_cw015_mw006"])
    path = scratch(spark, "summary")
    # The second run replaces what the first one wrote.
    for chosen in (configs[:1], configs):
        summary = experiments.run_grid_to(style(spark, folder), S.GRID_BASE, path, splits, chosen)
    return tidy(summary)


# --- learned models (no SQL equivalent) ----------------------------------------------------------------


WINDOWS = ranker.RankerWindows(S.TRAIN_CUTOFF, S.TRAIN_END, S.CUTOFF, S.VALID_END, seed=S.SEED)
RANKER = ranker.RankerParams()
TRIALS = 6  # as in the reference's tuned run


def _ranker_data(spark, folder):
    t = style(spark, folder)
    return t, ranker.ranker_data(t, WINDOWS, CANDIDATES)


def _trained(data):
    return ranker.train_ranker(data.train, RANKER, data.key)


@query
def ranker_recs(spark, folder):
    _, data = _ranker_data(spark, folder)
    return tidy(ranker.predict_ranker(_trained(data), data.evaluation, 10))


@query
def ranker_importance(spark, folder):
    _, data = _ranker_data(spark, folder)
    return tidy(_trained(data).importance())


@query
def ranker_tuning(spark, folder):
    _, data = _ranker_data(spark, folder)
    return tidy(ranker.trial_rows(spark, _tuned(data)[0]))


@query
def ranker_report(spark, folder):
    t, data = _ranker_data(spark, folder)
    trials, model = _tuned(data)
    return tidy(ranker.ranker_report(t, WINDOWS, data, trials, model, 10, S.EVENT_START))


@query
def ranker_first_gradients(spark, folder):
    _, data = _ranker_data(spark, folder)
    return tidy(boosting.gradient_table(data.train.withColumn("score", F.lit(0.0))).drop("score"))


def _tuned(data):
    return ranker.tune(data.train, data.evaluation, data.eval_truth, 10, ranker.tuning_trials(RANKER, TRIALS), data.key)


@query
def ranker_vs_hybrid(spark, folder):
    t, data = _ranker_data(spark, folder)
    return tidy(ranker.compare_with_hybrid(t, WINDOWS, data, _trained(data), 10, S.EVENT_START))


def _latent_inputs(spark, folder):
    t = sku(spark, folder)
    return t, customers.target_customers(t, S.DEFAULT), _heads(t)


def _als(spark, folder, whole=False):
    """Factors of the head items, or of the whole assortment."""
    if whole:
        t = sku(spark, folder)
        targets, heads = customers.target_customers(t, S.DEFAULT), interactions.bought_items(t.transactions, S.CUTOFF)
    else:
        t, targets, heads = _latent_inputs(spark, folder)
    pairs = interactions.interactions(t, S.CUTOFF, targets, heads, event_start=S.EVENT_START, whole=whole)
    return t, latent.train_als(pairs, heads, latent.AlsParams())


def _bpr(spark, folder):
    t, targets, heads = _latent_inputs(spark, folder)
    pairs = materialize(interactions.positive_pairs(t.transactions, S.CUTOFF, targets, heads), "bpr-pairs")
    return t, pairs, latent.train_bpr(pairs, heads, latent.BprParams())[0]


def _latent_blend(t, lists, name):
    base = hybrid.recommend(t, S.PRODUCTION)
    wanted = customers.truth(t.transactions, S.CUTOFF, S.VALID_END)
    return tidy(blending.blend_metrics(base, lists, wanted, blending.standard_variants(name), 10))


@query
def als_recs(spark, folder):
    return tidy(latent.als_lists(_als(spark, folder)[1]))


@query
def als_blend_metrics(spark, folder):
    t, model = _als(spark, folder, whole=True)
    return _latent_blend(t, latent.als_lists(model), "als")


@query
def als_normal_equations(spark, folder):
    """Whether each customer's stored factors solve their normal equations, to single precision."""
    found = latent.als_residuals(_als(spark, folder)[1])
    return found.select("customer_id", "n_items", (F.col("residual") < 1e-3).cast("bigint").alias("solved"))


@query
def bpr_recs(spark, folder):
    _, _, model = _bpr(spark, folder)
    return tidy(latent.bpr_lists(model, latent.BprParams().candidates))


@query
def bpr_blend_metrics(spark, folder):
    t, _, model = _bpr(spark, folder)
    return _latent_blend(t, latent.bpr_lists(model, latent.BprParams().candidates), "bpr")


@query
def bpr_pair_order(spark, folder):
    """Whether the stored factors put bought before other items, over all customers."""
    _, pairs, model = _bpr(spark, folder)
    rows = latent.bpr_order(model, pairs)
    return rows.agg(
        F.count("*").alias("customers"), F.sum("n_items").alias("pairs"), (F.avg("ordered") > 0.6).cast("bigint").alias("learned")
    )
