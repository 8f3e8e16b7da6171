"""What stays on disk: shuffle files, tables that are needed for a while, pairs of baskets."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from rebuy.operators import periods, skew
from rebuy.plans import experiments
from rebuy.session import in_background, materialize, passing, settle, shared_dir
from tests.test_periods import CFG, CUTOFFS, shop  # noqa: F401
from tests.test_properties import collected


def shuffled(spark) -> set[str]:
    """Shuffle files of this session."""
    found = set()
    for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        found |= {name for _, _, names in os.walk(folder.getPath()) for name in names if name.startswith("shuffle_")}
    return found


def test_shuffle_files_go_with_their_job(spark):
    settle(spark)
    before = shuffled(spark)
    rows = materialize(spark.range(0, 10_000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert not shuffled(spark) - before
    again = spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(again.collect()) == sorted(again.collect()) and rows.count() == 7


def test_passing_tables_are_removed(spark):
    with passing(spark):
        first = materialize(spark.range(3), "first")
        second = in_background(spark, lambda: materialize(spark.range(4), "second")).result()
        stays = materialize(first.crossJoin(second.withColumnRenamed("id", "other")), "stays", lasting=True)
        gone = [re.sub("^file:", "", path) for table in (first, second) for path in table.inputFiles()]
        assert gone and all(os.path.exists(path) for path in gone)
    assert not any(os.path.exists(path) for path in gone) and stays.count() == 12
    assert materialize(spark.range(3), "first").count() == 3


def test_a_grid_leaves_its_summary_only(spark, shop):  # noqa: F811
    folder = os.path.join(shared_dir(spark), "rebuy")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    splits = [experiments.Split(c, c, "2025-12-20") for c in CUTOFFS[1:3]]
    summary = experiments.run_grid(shop, CFG, splits, experiments.CONFIGS[:3])
    kinds = {re.sub("-[0-9a-f]{32}$", "", name) for name in set(os.listdir(folder)) - before}
    assert kinds <= {"split-summary", "signal-periods", "basket-periods"} and "split-summary" in kinds
    assert summary.count() == 6


def test_pairs_move_once_for_all_cutoffs(spark, shop, monkeypatch):  # noqa: F811
    """All cutoffs in one pass equal each by itself, also where every item is spread over salts."""
    found = materialize(periods.basket_periods(shop.transactions, CUTOFFS, 4), "test-periods")
    each = sorted((*r, c) for c in set(CUTOFFS) for r in collected(periods.neighbors_at(found, CUTOFFS, c, 4, 3)))
    every = periods.neighbors_at(found, CUTOFFS, CUTOFFS, 4, 3)
    plan = every._jdf.queryExecution().executedPlan().toString()  # before it runs
    assert collected(every) == each and len(each) > 20
    assert plan.count("Exchange hashpartitioning") <= 2  # each cutoff by itself needed two
    monkeypatch.setattr(skew, "FINENESS", 100_000)
    spread = periods.neighbors_at(found, CUTOFFS, CUTOFFS, 4, 3)
    assert collected(spread) == each
