"""Small inputs with hand-computed answers."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rebuy.config import HybridConfig, metadata_levels
from rebuy.functions.scoring import SCALE
from rebuy.operators import blending, ceiling, copurchase, customers, features, metrics, popularity, signals
from rebuy.plans import hybrid
from rebuy.sources import sinks
from rebuy.sources.tables import shop_tables

CUTOFF, END = "2025-12-01", "2026-01-01"
TX = "customer_id bigint, item_id string, bill_id bigint, quantity double, price double, location bigint, updated_date timestamp_ntz"
EV = "customer_id bigint, item_id string, event_type string, quantity double, event_date timestamp_ntz"
ITEMS = "item_id string, category_l1 string, category_l2 string, category_l3 string, brand string, price double"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def tx_rows(spark, rows):
    return spark.createDataFrame(rows, TX)


def buy(customer, item, bill=1, quantity=1.0, price=5.0, location=7, when="2025-11-01"):
    return (customer, item, bill, quantity, price, location, at(when))


def tables(spark, tx=(), ev=(), items=()):
    return shop_tables(
        spark.createDataFrame(list(tx), TX), spark.createDataFrame(list(ev), EV), spark.createDataFrame(list(items), ITEMS)
    )


def points(df) -> list:
    return [(r["item_id"], r["signal"], None if r["points"] is None else round(r["points"], 6)) for r in df.collect()]


def test_signals(spark):
    bought = tx_rows(
        spark,
        [
            buy(1, "A", when="2025-10-02"),
            buy(1, ""),
            buy(1, "(not set)"),
            buy(1, None),
            buy(1, "B", when="2025-12-01"),
            buy(1, "N", quantity=None),
        ],
    )
    found = signals.purchase_signals(bought, None, CUTOFF, CUTOFF, 60.0)
    assert sorted(points(found), key=str) == [("A", "purchase", 2.943036), ("N", "purchase", None)]
    browsed = spark.createDataFrame(
        [
            (1, "A", "add_to_cart", 0.0, at("2025-11-30 18:00:00")),
            (1, "A", "view_item", 4.0, at("2025-11-30")),
            (1, "A", "signup", 1.0, at("2025-11-30")),
            (1, "A", "view_item", 1.0, at("2024-12-31")),
            (1, "", "view_item", 1.0, at("2025-11-30")),
        ],
        EV,
    )
    found = signals.event_signals(browsed, "2025-01-01", CUTOFF, CUTOFF, 60.0)
    # FIXTURES.md prints 2.346856 for the view; the formula it gives evaluates to 2.346852.
    view = round((1 + math.log(4)) * math.exp(-1 / 60), 6)
    assert sorted(points(found)) == [("A", "add_to_cart", 3.0), ("A", "view_item", view)]


def test_null_scores_still_count(spark):
    rows = tx_rows(spark, [buy(1, "A", quantity=None), buy(2, "A", quantity=None)])
    pairs = signals.customer_items(signals.purchase_signals(rows, None, CUTOFF, CUTOFF, 60.0))
    totals = popularity.item_totals(pairs).first()
    assert (totals["points"], totals["n"], totals["customers"]) == (0, 2, 2)
    history = signals.user_history(pairs, 5).collect()
    assert [(r["customer_id"], r["score"]) for r in history] == [(1, 0.0), (2, 0.0)]


def test_neighbors(spark):
    lines = [(1, "A"), (1, "A"), (1, "B"), (2, "A"), (2, "B"), (2, "C"), (3, "A")]
    lines += [(4, f"Z{i:02d}") for i in range(13)]
    tx = tx_rows(spark, [buy(1, item, bill) for bill, item in lines])
    found = copurchase.copurchase_neighbors(tx, CUTOFF, 12, 40).orderBy("item_id", "rnk").collect()
    assert [(r["item_id"], r["neighbor_id"], r["weight"], round(r["score"], 6)) for r in found] == [
        ("A", "B", 1.5, 1.0),
        ("A", "C", 0.5, 0.333333),
        ("B", "A", 1.5, 1.0),
        ("B", "C", 0.5, 0.333333),
        ("C", "A", 0.5, 1.0),
        ("C", "B", 0.5, 1.0),
    ]


@pytest.mark.parametrize("size", [23, 24, 40])
def test_basket_weights_do_not_depend_on_the_limit(spark, size):
    tx = tx_rows(spark, [buy(1, f"Z{i:02d}", 1) for i in range(size)] + [buy(1, f"Z{i:02d}", 2) for i in range(4)])
    found = copurchase.copurchase_neighbors(tx, CUTOFF, 40, 40).collect()
    weights = {(r["item_id"], r["neighbor_id"]): r["weight"] for r in found}
    assert weights["Z00", "Z01"] == pytest.approx(1 / (size - 1) + 1 / 3, abs=1e-15)
    assert weights["Z00", "Z10"] == pytest.approx(1 / (size - 1), abs=1e-15)


def test_dormant_customers_keep_their_order(spark):
    """Scores are relative: what was bought years ago still counts in full if nothing is newer."""
    old = [buy(1, "OLD", bill, when="2021-10-01") for bill in range(20)] + [buy(1, "ONCE", 50, when="2021-10-01")]
    older = [buy(3, "ANCIENT", 60, when="2009-01-01")]
    new = [buy(2, f"N{i}", 100 + i, when="2025-11-30") for i in range(12)]
    shop = tables(spark, old + older + new, [], [])
    cfg = HybridConfig(CUTOFF, END, include_events=False)
    history = signals.user_history(signals.customer_items(signals.train_signals(shop, cfg)), 5).collect()
    scores = {(r["customer_id"], r["item_id"]): r["score"] for r in history}
    assert scores[1, "OLD"] == scores[3, "ANCIENT"] == 1.0
    assert scores[1, "ONCE"] == pytest.approx(0.05)
    recs = hybrid.recommend(shop, cfg, mode="predict").filter("rnk <= 2").collect()
    ranks = {(r["customer_id"], r["rnk"]): r["item_id"] for r in recs}
    assert ranks[1, 1] == "OLD" and ranks[3, 1] == "ANCIENT"


def test_neighbours_of_nameless_shops_are_kept_apart(spark):
    one = tables(spark, [buy(1, "A", 1), buy(1, "B", 1)], [], [])
    two = tables(spark, [buy(1, "X", 1), buy(1, "Y", 1)], [], [])
    cfg = HybridConfig(CUTOFF, END)
    first, second = copurchase.cached_neighbors(one, cfg), copurchase.cached_neighbors(two, cfg)
    assert {r["item_id"] for r in first.collect()} == {"A", "B"}
    assert {r["item_id"] for r in second.collect()} == {"X", "Y"}


def test_summary_replaces_what_runs_again(spark, tmp_path):
    def rows(split, hits):
        values = [split, "c", "2025-01-01", "2025-02-01", hits, *[0.5] * 7]
        return spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'string' if i < 4 else 'bigint' if i == 4 else 'double'}" for i, n in enumerate(sinks.SUMMARY_COLUMNS)))

    path = str(tmp_path / "summary")
    for split, hits in (("a", 1), ("b", 2), ("a", 3)):
        sinks.write_summary(rows(split, hits), path)
    found = sinks.read_summary(spark, path)
    assert found.columns == sinks.SUMMARY_COLUMNS
    assert sorted((r["split"], r["total_correct"]) for r in found.collect()) == [("a", 3), ("b", 2)]


def test_killed_writers_leave_reports_readable(spark, tmp_path, monkeypatch):
    path, metrics = str(tmp_path / "metrics"), spark.createDataFrame([("all", 1)], "segment string, hits bigint")
    sinks.write_metrics(metrics, path)
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "name_current", lambda *args: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            sinks.write_metrics(metrics.withColumn("hits", F.lit(2)), path)
    assert [r.hits for r in sinks.read_metrics(spark, path).collect()] == [1]
    # A writer that dies while it writes leaves a folder that nothing names.
    (tmp_path / "metrics" / "data" / "half").mkdir()
    (tmp_path / "metrics" / "data" / "half" / "part-0.json").write_text('{"segment": "all", "hits"')
    assert [r.hits for r in sinks.read_metrics(spark, path).collect()] == [1]
    sinks.write_metrics(metrics.withColumn("hits", F.lit(3)), path)
    assert [r.hits for r in sinks.read_metrics(spark, path).collect()] == [3]
    # Two writers of a part: the last named one is read, whole.
    sinks.name_current(spark, path, ["metrics"], next(p.name for p in (tmp_path / "metrics" / "data").iterdir() if p.name != "half" and '"hits":1' in "".join(f.read_text() for f in p.glob("*.json"))))
    assert [r.hits for r in sinks.read_metrics(spark, path).collect()] == [1]


def _m3(spark):
    history = spark.createDataFrame([(1, "A", 1.0, 1), (1, "B", 0.5, 2)], "customer_id bigint, item_id string, score double, rnk int")
    near = spark.createDataFrame(
        [("A", [("C", 1.0), ("B", 0.4)]), ("B", [("A", 1.0), ("D", 0.2)])],
        "item_id string, near array<struct<neighbor_id:string,score:double>>",
    )
    grps = spark.createDataFrame([("A", ["brand:x"]), ("B", ["brand:x"])], "item_id string, grps array<string>")
    best = spark.createDataFrame([("brand:x", [("A", 1.0), ("E", 0.5)])], "grp string, best array<struct<item_id:string,score:double>>")
    popular = spark.createDataFrame([("D", 1, 1.0), ("A", 2, 0.6)], "item_id string, rnk int, score double")
    totals = spark.createDataFrame([("A", 1.0, 1, 1), ("B", 1.0, 1, 1)], "item_id string, points double, n bigint, customers bigint")
    pairs = spark.createDataFrame(
        [(1, "A", 10.0, at("2025-11-01"), 1), (1, "B", 5.0, at("2025-11-01"), 1)],
        "customer_id bigint, item_id string, points double, last_date timestamp_ntz, n bigint",
    )
    training = hybrid.Training(pairs, totals, popular, near, grps, best)
    targets = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    return history, training, targets


def _lists(recs):
    return [(r["customer_id"], r["item_id"], round(r["score"], 6)) for r in recs.orderBy("customer_id", "rnk").collect()]


def test_hybrid_blend(spark):
    _, training, targets = _m3(spark)
    cfg = HybridConfig(CUTOFF, END, copurchase_weight=0.15, category_weight=0.06, category_level="brand")
    recs = hybrid.recommend(tables(spark), cfg, targets=targets, training=training)
    wanted = [(1, "A", 1.165), (1, "B", 0.56), (1, "C", 0.15), (1, "D", 0.065), (1, "E", 0.03), (2, "D", 0.05), (2, "A", 0.03)]
    assert _lists(recs) == wanted


def test_spread_and_broadcast_lookups_agree(spark, monkeypatch):
    _, training, targets = _m3(spark)
    cfg = HybridConfig(CUTOFF, END, copurchase_weight=0.15, category_weight=0.06, category_level="brand")
    wanted = _lists(hybrid.recommend(tables(spark), cfg, targets=targets, training=training))
    monkeypatch.setattr("rebuy.operators.skew.BROADCAST_BYTES", -1)
    assert _lists(hybrid.recommend(tables(spark), cfg, targets=targets, training=training)) == wanted


def test_fallback_without_any_score(spark):
    _, training, targets = _m3(spark)
    flat = training.popular.withColumn("score", F.lit(None).cast("double"))
    training = hybrid.Training(training.pairs, training.totals, flat, training.near, training.item_groups, training.group_best)
    cfg = HybridConfig(CUTOFF, END, copurchase_weight=0.0)
    recs = hybrid.recommend(tables(spark), cfg, targets=targets, training=training)
    assert [(c, i) for c, i, _ in _lists(recs)] == [(1, "A"), (1, "B"), (1, "D"), (2, "D"), (2, "A")]


def ranked_rows(spark, lists: dict[int, list[str]]):
    rows = [(c, item, i + 1) for c, items in lists.items() for i, item in enumerate(items)]
    return spark.createDataFrame(rows, "customer_id bigint, item_id string, rnk bigint")


def truth_rows(spark, sets: dict[int, str]):
    rows = [(c, item) for c, items in sets.items() for item in items]
    return spark.createDataFrame(rows, "customer_id bigint, item_id string")


def test_metrics(spark):
    recs = ranked_rows(spark, {1: ["a", "x", "b"], 2: ["x", "y", "c"], 9: ["a"]})
    row = metrics.ranking_metrics(recs, truth_rows(spark, {1: "ab", 2: "c", 3: "defg"}), 3).first()
    assert (row["users_evaluated"], row["k"], row["total_correct"]) == (3, 3, 3)
    got = [round(row[n], 6) for n in ("precision_at_10_micro", "mean_iou", "global_iou", "mean_reciprocal_rank_first_hit", "map_at_k")]
    assert got == [0.333333, 0.333333, 0.3, 0.444444, 0.388889]


def test_metrics_without_truth_are_zero(spark):
    empty = truth_rows(spark, {1: ""})
    row = metrics.ranking_metrics(ranked_rows(spark, {1: ["a"]}), empty, 3).first()
    assert row["users_evaluated"] == 0 and row["map_at_k"] == 0.0 and row["precision_at_10_micro"] == 0.0
    seen = spark.createDataFrame([(1,)], "customer_id bigint")
    rows = metrics.segmented_metrics(ranked_rows(spark, {1: ["a"]}), truth_rows(spark, {1: "a"}), seen, 3).collect()
    assert {r["segment"]: r["users_evaluated"] for r in rows} == {"all": 1, "seen": 1, "cold": 0}


def test_blends(spark):
    def run(base, model, key, wanted="cd"):
        pairs = blending.paired_ranks(ranked_rows(spark, {1: base}), ranked_rows(spark, {1: model}), truth_rows(spark, {1: wanted}))
        rows = blending.blend(pairs, {"v": key}, 3).orderBy("rnk").collect()
        return [r["item_id"] for r in rows]

    base, model = ["a", "b", "c"], ["d", "b"]
    assert run(base, model, blending.reciprocal_rank_key(0.5)) == ["a", "b", "d"]
    assert run(base, model, blending.reciprocal_rank_key(0.02)) == ["a", "b", "c"]
    assert run(base, model, blending.keep_base_key(1)) == ["a", "d", "b"]
    assert run(base, model, blending.oracle_key()) == ["c", "d", "a"]
    assert run(["a", "b"], ["x"], blending.reciprocal_rank_key(0.5)) == ["a", "b", "x"]
    assert run(base, model, blending.only_key("model_rnk")) == ["d", "b"]


def test_candidate_recall(spark):
    row = metrics.candidate_recall(truth_rows(spark, {1: "ax", 2: "y"}), truth_rows(spark, {1: "ab", 2: "c", 3: "d"}), 1).first()
    assert (row["candidate_hits"], row["target_items"]) == (1, 4)
    assert (row["candidate_recall"], round(row["oracle_precision_at_10"], 6)) == (0.25, 0.333333)


def test_ceiling(spark):
    inside = "2025-12-05"
    t = tables(
        spark,
        [buy(1, "a", when=inside), buy(1, "b", when=inside), buy(1, "c", when=inside), buy(2, "d", when=inside), buy(1, "a")],
        [(1, "b", "signup", 1.0, at("2025-11-02"))],
    )
    segmented = ceiling.by_segment(ceiling.target_overlap(t, CUTOFF, END))
    rows = {(r["segment"], r["source"]): r for r in ceiling.overlap_summary(segmented, 10).collect()}
    row = rows["all", "prior_any"]
    assert (row["users"], row["recoverable_hits"], row["perfect_hits_at_k"]) == (2, 2, 4)
    got = [row[n] for n in ("recoverable_precision", "recoverable_recall", "perfect_precision", "user_recoverable_rate")]
    assert got == [0.1, 0.5, 0.2, 0.5]
    assert rows["seen", "repeat_purchase"]["users"] == 1
    sizes = {r["segment"]: r["users"] for r in ceiling.target_size_summary(segmented).collect()}
    assert sizes == {"all": 2, "seen": 1, "cold": 1}


def test_target_sizes(spark):
    rows = spark.createDataFrame([("all", n) for n in (1, 1, 2, 3, 10)], "segment string, target_n bigint")
    row = ceiling.target_size_summary(rows).first()
    assert list(row)[1:] == [5, 17, 3.4, 2.0, 3.0, 10.0, 10.0, 3, 2]


def test_history_candidate_score(spark):
    profile = features.purchase_profile(tx_rows(spark, [buy(1, "A", quantity=3.0), buy(1, "A", quantity=0.0)]), CUTOFF)
    row = features.history_candidates(profile, 5).first()
    assert round(row["score"] / SCALE, 6) == 5.386294


def test_feature_defaults(spark):
    t = tables(spark, [buy(1, "A", when="2025-12-05")], [], [("A", None, None, None, None, 5.0)])
    users = spark.createDataFrame([(1,)], "customer_id bigint")
    inputs = features.ranker_inputs(t, CUTOFF, users)
    offered = features.merge_candidates({"source_global": truth_rows(spark, {1: "A"})})
    row = features.feature_frame(inputs, offered, END, features.CandidateConfig()).first()
    got = {name: round(row[name], 6) for name in features.FEATURES}
    expected = {"user_avg_price": 5.0, "item_avg_price": 5.0, "price_ratio": 0.833333, "ui_days_since_last": 9999.0}
    expected |= {"user_days_since_last": 9999.0, "purchase_share": 0.0, "source_global": 1.0, "source_group": 0.0}
    assert row["label"] == 1
    assert {name: got[name] for name in expected} == expected


def test_dominant_location(spark):
    days = ["2025-11-01", "2025-11-02", "2025-11-03", "2025-11-04"]
    tx = tx_rows(spark, [buy(1, "A", location=loc, when=day) for loc, day in zip((7, 7, 9, 9), days)])
    users = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    assert [tuple(r) for r in popularity.user_location(tx, CUTOFF, users).collect()] == [(1, 9)]


def test_metadata_levels():
    assert metadata_levels(" brand , category_l3") == ["brand", "category_l3"]
    assert metadata_levels("") == ["category_l2"]
    with pytest.raises(ValueError):
        metadata_levels("brand,colour")


def test_targets(spark):
    t = tables(spark, [buy(1, "A"), buy(2, "A", when="2025-12-05")], [(3, "A", "signup", 1.0, at("2025-11-02"))])
    cfg = HybridConfig(CUTOFF, END)

    def ids(df):
        return sorted(r[0] for r in df.collect())

    assert ids(customers.target_customers(t, cfg)) == [2]
    assert ids(customers.target_customers(t, cfg, "predict")) == [1, 2, 3]
    assert ids(customers.target_customers(t, cfg.with_(include_events=False), "predict")) == [1, 2]
    with pytest.raises(ValueError):
        customers.target_customers(t, cfg, "train")
