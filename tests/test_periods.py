"""Sums that several cutoffs share, against what each cutoff gives alone."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rebuy.config import HybridConfig
from rebuy.operators import copurchase, periods, signals
from rebuy.plans import experiments
from rebuy.sources.tables import shop_tables
from tests.test_fixtures import EV, ITEMS, TX
from tests.test_properties import random_shop

CUTOFFS = ["2025-12-20", "2025-11-01", "2025-12-01", "2025-11-01"]
CFG = HybridConfig("2025-12-01", "2026-01-01", event_start="2025-10-15", half_life_days=30.0)


@pytest.fixture(scope="module")
def shop(spark):
    """Bills whose lines lie days apart, repeat, and grow beyond the limit from one cutoff to the next."""
    rng = random.Random(11)
    start = datetime(2025, 10, 1)
    tx = []
    for bill in range(250):
        first = start + timedelta(days=rng.randint(0, 85), hours=rng.randint(0, 23))
        for _ in range(rng.choice([1, 2, 3, 12, 14])):
            when = first + timedelta(days=rng.choice([0, 0, 0, 20, 40]))
            item = rng.choice(["hot", *(f"i{n}" for n in range(18)), None, ""])
            tx.append((rng.randint(0, 9), item, None if bill == 7 else bill, rng.choice([None, 0.0, 2.0]), 2.0, 1, when))
    ev = [(rng.randint(0, 9), f"i{rng.randint(0, 18)}", rng.choice(["view_item", "add_to_cart", "other"]), 1.0, start + timedelta(days=rng.randint(0, 85))) for _ in range(300)]
    return shop_tables(spark.createDataFrame(tx, TX), spark.createDataFrame(ev, EV), spark.createDataFrame([("hot", "a", "b", "c", "d", 1.0)], ITEMS))


def test_signals_add_up(shop):
    found = periods.signal_periods(shop, CUTOFFS, CFG)
    for cutoff in set(CUTOFFS):
        alone = signals.customer_items(signals.train_signals(shop, CFG.with_(cutoff=cutoff))).collect()
        shared = periods.customer_items_at(found, CUTOFFS, cutoff, CFG.half_life_days).collect()
        wanted = {(r.customer_id, r.item_id): r for r in alone}
        assert len(shared) == len(wanted) > 50
        for r in shared:
            w = wanted[(r.customer_id, r.item_id)]
            assert (r.last_date, r.n) == (w.last_date, w.n) and r.points == pytest.approx(w.points, rel=1e-12)


@pytest.mark.parametrize("limit", [2, 3, 12])
def test_baskets_add_up(shop, limit):
    found = periods.basket_periods(shop.transactions, CUTOFFS, limit)
    for cutoff in set(CUTOFFS):
        alone = copurchase.copurchase_neighbors(shop.transactions, cutoff, limit, 6).collect()
        shared = periods.neighbors_at(found, CUTOFFS, cutoff, limit, 6).collect()
        key = lambda r: (r.item_id, r.rnk, r.neighbor_id, round(r.weight, 9), round(r.score, 9))
        assert sorted(map(key, shared)) == sorted(map(key, alone)) and alone
    # Growing bills take something back.
    if limit == 12:
        assert found.filter("units < 0").count() > 0


def test_random_shop_grid_is_that_of_single_splits(spark):
    shop = random_shop(spark, 5, 3)
    splits = [experiments.Split("a", "2025-11-10", "2025-12-01"), experiments.Split("b", "2025-12-01", "2026-01-01")]
    configs = experiments.CONFIGS[1:3]
    base = CFG.with_(max_neighbors=5)
    both = experiments.run_grid(shop, base, splits, configs).orderBy("split", "config").collect()
    alone = [r for s in splits for r in experiments.run_grid(shop, base, [s], configs).orderBy("config").collect()]
    assert both == alone and len(both) == 4


def test_one_scan_of_the_transactions(shop):
    """The shared sums read each table once, whatever the number of cutoffs."""
    found = periods.signal_periods(shop, CUTOFFS, CFG)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2 and plan.count("Aggregate") == 1


def test_cutoffs_are_whole_days_apart():
    assert periods.ascending(CUTOFFS) == ["2025-11-01", "2025-12-01", "2025-12-20"]
    with pytest.raises(ValueError):
        periods.ascending(["2025-11-01", "2025-11-02 12:00:00"])
    assert periods.units(12) % 11 == 0 and periods.units(2) == 1
