"""Headline jobs on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

The window is the last month of the order table, so that nearly all rows are
history. Each job runs once to warm up, then three times; the median counts.
Nothing is cached between runs: every run starts from the Parquet files.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from rebuy.config import production_config
from rebuy.operators import ceiling, copurchase, customers, features, interactions, popularity, signals
from rebuy.plans import experiments, hybrid
from rebuy.session import local_session
from rebuy.sources.star_schema import star_tables

CUTOFF, END, EVENT_START = "2001-07-01", "2001-08-01", "2001-06-10"
FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
CFG = production_config(CUTOFF, END, event_start=EVENT_START)


def jobs(spark) -> dict:
    def sku():
        return star_tables(spark, FOLDER, CUTOFF, "sku")

    def style():
        return star_tables(spark, FOLDER, CUTOFF, "style")

    def frame():
        t, cfg = style(), features.CandidateConfig(event_start=EVENT_START)
        inputs = features.ranker_inputs(t, CUTOFF, customers.sample_customers(t.transactions, CUTOFF, END, 120_000, 42))
        return features.feature_frame(inputs, features.candidate_rows(inputs, cfg), END, cfg)

    def overlap():
        return ceiling.overlap_summary(ceiling.by_segment(ceiling.target_overlap(style(), CUTOFF, END, EVENT_START)), 10)

    def matrix():
        t = sku()
        heads = interactions.head_items(t.transactions, CUTOFF, 10_000)
        pairs = interactions.interactions(t, CUTOFF, customers.target_customers(t, CFG), heads, EVENT_START)
        return interactions.interaction_matrix(pairs)

    def pairs():
        return signals.customer_items(signals.train_signals(sku(), CFG))

    def grid():
        split = [experiments.Split("last", CUTOFF, END)]
        return experiments.run_grid(style(), CFG, split)

    return {
        "customer_items": pairs,
        "user_history": lambda: signals.user_history(pairs(), CFG.max_user_items),
        "global_scores": lambda: popularity.global_scores(popularity.item_totals(pairs()), CFG.global_limit),
        "copurchase_neighbors": lambda: copurchase.copurchase_neighbors(sku().transactions, CUTOFF, 12, 40),
        "hybrid_recs": lambda: hybrid.recommend(sku(), CFG),
        "hybrid_recs_predict": lambda: hybrid.recommend(sku(), CFG, mode="predict"),
        "metrics_by_segment": lambda: hybrid.validate(style(), CFG).metrics,
        "ceiling_overlap": overlap,
        "feature_frame": frame,
        "interaction_matrix": matrix,
        "grid_one_split": grid,
    }


def main() -> None:
    spark = local_session(CPUS, partitions=max(8, int(CPUS)), memory="16g")
    # Small inputs: let the adaptive planner keep more than one task per stage.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    times: dict[str, float] = {}
    for name, job in jobs(spark).items():
        seconds = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        times[name] = round(statistics.median(seconds[1:]), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(FOLDER.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
