"""Invariants on seeded random tables."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebuy.config import production_config
from rebuy.operators import boosting, copurchase, customers, features, interactions, products, skew
from rebuy.operators.skew import FINENESS, heaviest, spread_join
from rebuy.plans import experiments, hybrid, latent
from rebuy.session import shared_dir
from rebuy.sources import sinks
from rebuy.sources.tables import conform, read_targets, shop_tables
from tests.test_fixtures import EV, ITEMS, TX

CUTOFF, END = "2025-12-01", "2026-01-01"


def random_shop(spark, seed: int, parts: int):
    rng = random.Random(seed)
    base = datetime(2025, 12, 1)
    # One customer and one item hold about a third of the rows.
    who = [7] * 10 + list(range(20))
    what = ["hot"] * 12 + [f"i{n}" for n in range(25)]
    tx, ev = [], []
    for bill in range(300):
        customer, day = rng.choice(who), base + timedelta(days=rng.randint(-90, 25))
        for _ in range(rng.choice([1, 2, 3, 15])):
            tx.append((customer, rng.choice(what), bill, float(rng.randint(0, 4)), 2.0, rng.randint(1, 3), day))
    for _ in range(300):
        kind = rng.choice(["view_item", "add_to_cart", "error"])
        ev.append((rng.choice(who), rng.choice(what), kind, 1.0, base + timedelta(hours=rng.randint(-900, 10))))
    items = [(name, None, "c", f"t{n % 4}", f"b{n % 5}" if n % 7 else None, 3.0) for n, name in enumerate(sorted(set(what)))]
    frames = [spark.createDataFrame(rows, schema).repartition(parts) for rows, schema in ((tx, TX), (ev, EV), (items, ITEMS))]
    return shop_tables(*frames)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def shop(spark):
    return random_shop(spark, 1, 3)


CFG = production_config(CUTOFF, END, location_weight=0.03)


def test_same_output_for_any_partitioning(spark, shop):
    other = random_shop(spark, 1, 7)
    assert collected(hybrid.recommend(shop, CFG)) == collected(hybrid.recommend(other, CFG))


def test_spread_lookups_change_nothing(shop, monkeypatch):
    wanted = collected(hybrid.recommend(shop, CFG, mode="predict"))
    monkeypatch.setattr("rebuy.operators.skew.BROADCAST_BYTES", -1)
    assert collected(hybrid.recommend(shop, CFG, mode="predict")) == wanted


def test_only_lists_that_are_too_large_move(spark, shop, monkeypatch):
    """Small lists stay broadcast next to large ones, which come back whole: no row is expanded before it moves."""
    wanted = collected(hybrid.recommend(shop, CFG, mode="predict"))
    training = hybrid.train(shop, CFG)
    targets = customers.target_customers(shop, CFG, "predict")
    monkeypatch.setattr("rebuy.plans.hybrid.stored_bytes", lambda df: skew.BROADCAST_BYTES + 1 if "near" in lists_of(df) else 1)
    found = hybrid.evidence_lists(shop, CFG, targets, training)
    assert found.spread_kinds == (hybrid.COPURCHASE,) and found.at_hand is not None
    assert collected(hybrid.recommend(shop, CFG, mode="predict", targets=targets, training=training)) == wanted
    plan = hybrid.collect_evidence(shop, CFG, targets, training)._jdf.queryExecution().optimizedPlan().toString()
    moves = plan.index("RepartitionByExpression [customer_id")
    assert "zip_with" in plan[:moves] and "zip_with" not in plan[moves:]


def lists_of(df) -> str:
    """The names of the stored tables a frame reads."""
    return " ".join(path.rsplit("/", 2)[-2].rsplit("-", 1)[0] for path in df.inputFiles())


def test_shorter_lists_are_prefixes(shop):
    training = hybrid.train(shop, CFG)
    long = hybrid.recommend(shop, CFG, training=training)
    short = hybrid.recommend(shop, CFG.with_(k=4), training=training)
    assert collected(long.filter("rnk <= 4")) == collected(short)


def test_lists_are_complete(shop):
    recs = hybrid.recommend(shop, CFG, mode="predict")
    counts = recs.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.countDistinct("item_id").alias("items"), F.max("rnk").alias("last")
    )
    targets = customers.target_customers(shop, CFG, "predict").count()
    rows = counts.collect()
    assert len(rows) == targets
    assert all(r["n"] == r["items"] == r["last"] == 10 for r in rows)


def test_popular_items_need_no_cross_join(spark, shop):
    """The ranking equals the one over customers x popular items, also at other global weights."""
    for weight in (0.0, 0.05, 2.0, -0.5):
        cfg = CFG.with_(global_weight=weight)
        training = hybrid.train(shop, cfg)
        targets = customers.target_customers(shop, cfg, "predict")
        evidence = hybrid.collect_evidence(shop, cfg, targets, training).collect()
        popular = [(r["item_id"], r["score"]) for r in training.popular.collect()]
        scores: dict = {}
        for row in evidence:
            mine = scores.setdefault(row["customer_id"], {})
            if row["item_id"] is None:
                continue
            parts = [cfg.repeat_weight * (row["repeat"] or 0.0)]
            parts += [cfg.copurchase_weight * (row["copurchase"] or 0.0), cfg.category_weight * (row["category"] or 0.0)]
            parts += [cfg.location_weight * (row["location"] or 0.0)]
            mine[row["item_id"]] = sum(parts)
        glob = dict(popular)
        wanted = []
        for customer, mine in scores.items():
            full = {item: mine.get(item, 0.0) + weight * glob.get(item, 0.0) for item in set(mine) | set(glob)}
            order = sorted(full, key=lambda item: (round(full[item], 9), glob.get(item, 0.0), item), reverse=True)
            wanted += [(customer, item, place + 1) for place, item in enumerate(order[: cfg.k])]
        recs = hybrid.recommend(shop, cfg, targets=targets, training=training).select("customer_id", "item_id", "rnk")
        assert collected(recs) == sorted(wanted)


def test_baskets_equal_self_join(shop):
    lines = shop.transactions.filter(F.col("updated_date") < CUTOFF).select("bill_id", "item_id").distinct()
    small = lines.groupBy("bill_id").agg(F.count("*").alias("n")).filter("n between 2 and 12")
    other = lines.withColumnRenamed("item_id", "neighbor_id")
    naive = lines.join(small, "bill_id").join(other, "bill_id").filter("item_id <> neighbor_id")
    naive = naive.groupBy("item_id", "neighbor_id").agg(F.round(F.sum(1 / (F.col("n") - 1)), 6).alias("weight"))
    found = copurchase.copurchase_neighbors(shop.transactions, CUTOFF, 12, 1000)
    assert collected(found.select("item_id", "neighbor_id", F.round("weight", 6))) == collected(naive)


def test_neighbor_scores(shop):
    found = copurchase.copurchase_neighbors(shop.transactions, CUTOFF, 12, 5)
    rows = found.groupBy("item_id").agg(F.max("score").alias("top"), F.min("score").alias("low"), F.max("rnk").alias("n")).collect()
    assert all(r["top"] == 1.0 and 0 < r["low"] <= 1 and r["n"] <= 5 for r in rows)


def test_spread_join_equals_join(spark):
    left = spark.range(1000).select(F.col("id").alias("customer_id"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).alias("key"))
    right = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    hot = heaviest(left.groupBy("key").agg(F.count("*").alias("n")), "key", "n", 8)
    assert {r.key: r.copies for r in hot.collect()} == {0: 14}  # 412 of 1,000 rows, 32 a salt
    for how in ("inner", "left"):
        spread = spread_join(left, right, "key", hot, "customer_id", how).select("customer_id", "key", "value")
        plain = left.join(right, "key", how).select("customer_id", "key", "value")
        assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_no_task_of_a_spread_join_is_hot(spark):
    """One key holds 30 % of the rows, two more 4 % each."""
    tasks = 64
    kind = F.when(F.col("id") < 30_000, 0).when(F.col("id") < 34_000, 1).when(F.col("id") < 38_000, 2).otherwise(F.col("id") % 5000 + 3)
    left = spark.range(100_000).select(F.col("id").alias("customer_id"), kind.alias("key"))
    right = left.select("key").distinct().withColumn("value", F.col("key") * 2)
    hot = heaviest(left.groupBy("key").agg(F.count("*").alias("n")), "key", "n", tasks)
    assert hot.count() == 3 and hot.count() < FINENESS * tasks
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = []
        for joined in (spread_join(left, right, "key", hot, "customer_id"), left.join(right, "key")):
            counts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
            sizes.append(sorted(r["count"] for r in counts))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert sum(sizes[0]) == sum(sizes[1]) == 100_000
    assert sizes[0][-1] <= 3 * sizes[0][len(sizes[0]) // 2]
    assert sizes[1][-1] > 10 * sizes[1][len(sizes[1]) // 2]  # a plain join


def test_sample_is_the_global_md5_order(spark, shop):
    everyone = customers.buyers(shop.transactions, CUTOFF, END)
    naive = everyone.orderBy(F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(":5"))), "customer_id").limit(6)
    assert collected(customers.sample_customers(shop.transactions, CUTOFF, END, 6, 5)) == collected(naive)
    assert customers.sample_customers(shop.transactions, CUTOFF, END, 10_000, 5).count() == everyone.count()


def test_dense_index(spark):
    keys = spark.range(5000).select((F.col("id") * 37 - 900).alias("customer_id")).repartition(6)
    rows = interactions.dense_index(keys, "customer_id", "idx").orderBy("customer_id").collect()
    assert [r["idx"] for r in rows] == list(range(5000))


def test_grid_equals_single_runs(shop):
    split = experiments.Split("last", CUTOFF, END)
    configs = experiments.named(experiments.CONFIGS, ["baseline_hl60", "brand_l3_hl60_cw015_mw006", "brand_l3_hl90_cw015_mw006"])
    base = production_config(CUTOFF, END)
    grid = {r["config"]: r for r in experiments.run_grid(shop, base, [split], configs).collect()}
    assert set(grid) == {c.name for c in configs}
    for config in configs:
        rows = {r["segment"]: r for r in hybrid.validate(shop, config.on(base, split)).metrics.collect()}
        row = grid[config.name]
        assert row["total_correct"] == rows["all"]["total_correct"]
        assert row["map_at_k"] == rows["all"]["map_at_k"]
        assert row["seen_precision_at_10"] == rows["seen"]["precision_at_10_micro"]


def test_lists_survive_both_formats(spark, shop, tmp_path):
    recs = hybrid.recommend(shop, CFG).select("customer_id", "item_id", "rnk")
    for fmt in ("parquet", "json"):
        sinks.write_lists(recs, str(tmp_path / fmt), fmt)
        assert collected(sinks.read_lists(spark, str(tmp_path / fmt), fmt)) == collected(recs)
    targets = customers.target_customers(shop, CFG)
    sinks.write_targets(targets, str(tmp_path / "targets.csv"))
    targets.write.parquet(str(tmp_path / "targets.PARQUET"))
    for name in ("targets.csv", "targets.PARQUET"):
        assert collected(read_targets(spark, str(tmp_path / name))) == collected(targets)


def test_contract_names_missing_columns(spark):
    with pytest.raises(ValueError, match="brand"):
        conform(spark.createDataFrame([("a",)], "item_id string"), {"item_id": "string", "brand": "string"}, "items")


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured


# --- learned models ----------------------------------------------------------------------------------


def test_best_products_match_a_full_sort():
    rng = np.random.default_rng(1)
    for spread in (0.0, 2.0):
        items = np.round(rng.normal(size=(200, 6)) * np.exp(spread * rng.normal(size=(200, 1))), 2)
        items[50] = items[20] = items[120]  # equal products
        users = np.round(rng.normal(size=(40, 6)), 1)
        users[3] = 0
        plain = users @ items.T
        for n in (1, 7, 30, 200, 500):
            scores, columns, made = products.best_products(users, products.item_blocks(items, 16), n)
            wanted = np.lexsort((np.broadcast_to(np.arange(200), plain.shape), -np.round(plain, 9)), axis=1)[:, :n]
            assert np.allclose(scores, np.take_along_axis(plain, wanted, axis=1))
            same = np.isclose(np.diff(np.take_along_axis(plain, wanted, axis=1), axis=1), 0).any(axis=1)
            assert np.array_equal(columns[~same], wanted[~same]) and made <= plain.size
    assert made == plain.size
    scores, columns, made = products.best_products(users, products.item_blocks(items, 16), 5)
    assert made < 0.7 * plain.size  # norms differ widely: most blocks are never read


def test_best_products_of_2000_items():
    rng = np.random.default_rng(2)
    items, users = rng.normal(size=(2000, 16)) * rng.exponential(size=(2000, 1)), rng.normal(size=(64, 16))
    scores, columns, made = products.best_products(users, products.item_blocks(items), 50)
    wanted = np.argsort(-(users @ items.T), axis=1)[:, :50]
    assert np.array_equal(columns, wanted) and made < users.shape[0] * 2000


def taste_pairs(spark):
    """Two camps of customers with disjoint tastes."""
    rng = random.Random(4)
    rows = {(c, (c % 2) * 10 + rng.randrange(10)) for c in range(120) for _ in range(6)}
    pairs = spark.createDataFrame([(c, f"i{n}", n, 1.0) for c, n in sorted(rows)], "customer_id bigint, item_id string, item_idx int, rating double")
    heads = spark.createDataFrame([(f"i{n}", n) for n in range(20)], "item_id string, item_idx int")
    return pairs, heads


def camp_share(lists) -> float:
    rows = lists.filter("rnk <= 5").collect()
    return sum((int(r["item_id"][1:]) >= 10) == bool(r["customer_id"] % 2) for r in rows) / len(rows)


def test_bpr_learns_and_repeats(spark):
    pairs, heads = taste_pairs(spark)
    params = latent.BprParams(factors=8, epochs=4, batch_size=256, batches_per_epoch=150, buckets=3, learning_rate=0.1)
    model, accuracy = latent.train_bpr(pairs.drop("rating"), heads, params)
    assert accuracy[-1] > accuracy[0] and accuracy[-1] > 0.7
    lists = latent.bpr_lists(model, 50)
    assert camp_share(lists) > 0.9
    order = latent.bpr_order(model, pairs).collect()
    assert len(order) == 120 and sum(r.ordered for r in order) / 120 > 0.6 and all(0 <= r.ordered <= 1 for r in order)
    again = latent.bpr_lists(latent.train_bpr(pairs.drop("rating").repartition(5), heads, params)[0], 50)
    keys = ["customer_id", "item_id", "rnk"]
    assert collected(lists.select(*keys)) == collected(again.select(*keys))


def test_als_finds_the_camps(spark):
    pairs, heads = taste_pairs(spark)
    model = latent.train_als(pairs, heads, latent.AlsParams(factors=4, iterations=5, alpha=10.0))
    lists = latent.als_lists(model)
    assert camp_share(lists) > 0.9
    assert lists.groupBy("customer_id").count().filter("count <> 20").count() == 0
    found = latent.als_residuals(model).collect()
    assert len(found) == 120 and all(r.residual < 1e-3 for r in found)
    wanted = {r.customer_id: r.n for r in pairs.groupBy("customer_id").agg(F.count("*").alias("n")).collect()}
    assert {r.customer_id: r.n_items for r in found} == wanted
    moved = model.customers.withColumn("factors", F.transform("factors", lambda x: x * 1.01))
    assert min(r.residual for r in latent.als_residuals(replace(model, customers=moved)).collect()) > 1e-3


def test_two_lists_in_one_plan(shop):
    """Lists that share stages of one plan are the same as lists planned alone."""
    training = hybrid.train(shop, CFG)
    targets = customers.target_customers(shop, CFG, "predict")
    configs = [CFG, CFG.with_(k=5, repeat_weight=0.0, category_weight=0.0, location_weight=0.0)]
    alone = [collected(hybrid.recommend(shop, cfg, targets=targets, training=training)) for cfg in configs]
    first, second = (
        hybrid.recommend(shop, cfg, targets=targets, training=training).withColumn("n", F.lit(i)) for i, cfg in enumerate(configs)
    )
    both = first.unionByName(second).collect()
    for i in (0, 1):
        assert sorted(tuple(r)[:-1] for r in both if r["n"] == i) == alone[i]


def test_task_functions_need_no_package(tmp_path):
    """What runs in tasks can be loaded where this package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.bin").write_bytes(cloudpickle.dumps((boosting.lambda_gradients, boosting._finish({}, []), latent.block_rounds, latent.BprParams())))
    code = "from pyspark import cloudpickle; cloudpickle.loads(open('f.bin', 'rb').read())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
