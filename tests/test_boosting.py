"""The ranker: gradients, binned blocks, trees grown in two ways, kept models and trials."""

from __future__ import annotations

import math
import uuid
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from catalog import queries, settings as S
from rebuy.operators import boosting, features
from rebuy.plans import ranker
from rebuy.session import kept, kept_folder, materialize
from rebuy.sources.star_schema import star_tables

WINDOWS = ranker.RankerWindows(S.TRAIN_CUTOFF, S.TRAIN_END, S.CUTOFF, S.VALID_END)
SMALL = ranker.RankerParams(num_boost_round=6, num_leaves=7, min_data_in_leaf=5, learning_rate=0.2)


@pytest.fixture(scope="module")
def data(spark):
    tables = replace(star_tables(spark, "/root/testdata/sf0.001", S.CUTOFF, "style"), source_key="")
    return ranker.ranker_data(tables, WINDOWS, features.CandidateConfig(event_start=S.EVENT_START))


def collected(frame):
    return sorted(map(tuple, frame.collect()))


def plain_gradients(label, score):
    """One customer at a time, one pair at a time."""
    n = len(label)
    place = {i: p + 1 for p, i in enumerate(sorted(range(n), key=lambda i: (-score[i], i)))}
    ideal = sum(1 / math.log2(1 + p) for p in range(1, int(sum(label)) + 1))
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if label[i] and not label[j]:
                swap = abs(1 / math.log2(1 + place[i]) - 1 / math.log2(1 + place[j])) / ideal
                wrong = 1 / (1 + math.exp(score[i] - score[j]))
                g[i], g[j] = g[i] + wrong * swap, g[j] - wrong * swap
                h[i], h[j] = h[i] + wrong * (1 - wrong) * swap, h[j] + wrong * (1 - wrong) * swap
    return g, h


def test_gradients_match_plain_ones():
    rng = np.random.default_rng(3)
    sizes = np.append(rng.integers(1, 30, 40), [1, 5, 5])
    label = (rng.random(sizes.sum()) < 0.2).astype(np.int64)
    label[-10:-5], label[-5:] = 1, 0
    score = np.round(rng.normal(size=len(label)), 1)
    g, h = boosting.lambda_gradients(sizes, label, score)
    at = 0
    for n in sizes:
        wanted = plain_gradients(label[at : at + n], score[at : at + n])
        assert np.allclose(g[at : at + n], wanted[0]) and np.allclose(h[at : at + n], wanted[1])
        at += n
    assert abs(g.sum()) < 1e-9 and (h >= 0).all()


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
@pytest.mark.parametrize("rows", [1, 20, 10_000])
def test_groups_are_never_cut(size, rows):
    owner = np.repeat(np.arange(40), np.random.default_rng(1).integers(1, 30, 40))
    table = pa.table({"customer_id": owner, "x": np.arange(len(owner))})
    parts = list(boosting._whole_groups(iter(table.to_batches(max_chunksize=size)), "customer_id", rows))
    assert pa.concat_tables(parts).equals(table)
    seen = [set(p["customer_id"].to_pylist()) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen))


def test_bins_keep_order_and_rare_values(spark):
    rows = [(c, f"i{c}", int(c % 9 == 0), float(c % 50), 1.0 if c == 77 else 0.0, None if c % 3 else float(c)) for c in range(500)]
    frame = spark.createDataFrame(rows, "customer_id long, item_id string, label int, a double, b double, c double")
    blocks = boosting.binned_blocks(frame, ["a", "b", "c"], 1)
    assert all(len(e) < boosting.MAX_BINS and (np.diff(e) > 0).all() for e in blocks.edges)
    block = [boosting._block(r.asDict(), 1) for r in blocks.rows.collect()]
    bins = np.concatenate([b[3] for b in block], axis=1)
    assert bins.shape == (3, 500)
    assert len(np.unique(bins[0])) > 25 and sorted(np.unique(bins[1], return_counts=True)[1]) == [1, 499]
    assert (bins[2] == len(blocks.edges[2])).sum() == sum(r[5] is None for r in rows)


def scores_of_trees(trees, frame, edges):
    """Every row through every tree, node by node."""
    out = {}
    for row in frame.collect():
        total = 0.0
        for tree in trees:
            node = 0
            while tree.child[node]:
                f = tree.feature[node]
                node = tree.child[node] + (not float(row[features.FEATURES[f]]) <= edges[f][tree.bin[node]])
            total += 0.2 * tree.value[node]
        out[(row.customer_id, row.item_id)] = total
    return out


def test_trees_are_the_same_however_they_are_grown(spark, data, monkeypatch):
    settings = [SMALL, replace(SMALL, num_leaves=12, lambda_l2=1.0, num_boost_round=3, min_data_in_leaf=20)]
    wanted = None
    for local, task, block in ((200_000, 100_000, 20_000), (0, 300, 90), (400, 300, 50)):
        monkeypatch.setattr(boosting, "LOCAL_ROWS", local)
        monkeypatch.setattr(boosting, "TASK_ROWS", task)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        blocks = boosting.binned_blocks(data.train, features.FEATURES, 42)
        found = [boosting.node_rows(trees, blocks.edges) for trees in boosting.boost(blocks, settings)]
        wanted = wanted or found
        assert found == wanted
    assert [len({r[0] for r in rows}) for rows in wanted] == [6, 3]
    for rows, limit in zip(wanted, (7, 12)):
        for tree in {r[0] for r in rows}:
            assert sum(r[0] == tree and r[2] is None for r in rows) <= limit
    alone = boosting.boost(blocks, settings[1:])
    assert boosting.node_rows(alone[0], blocks.edges) == wanted[1]


def test_first_split_is_the_best_of_all(data):
    """Against every border of every feature, from plain gradients."""
    params = replace(SMALL, num_boost_round=1, num_leaves=2, feature_fraction=1.0, bagging_fraction=1.0)
    blocks = boosting.binned_blocks(data.train, features.FEATURES, 42)
    tree = boosting.boost(blocks, [params])[0][0]
    rows = data.train.orderBy("customer_id", "item_id").collect()
    g, h = [], []
    for customer in sorted({r.customer_id for r in rows}):
        mine = [r.label for r in rows if r.customer_id == customer]
        for out, part in zip((g, h), plain_gradients(mine, [0.0] * len(mine))):
            out += part
    g, h = np.array(g), np.array(h)
    used = h > boosting.UNIT
    g, h = g[used], h[used]
    best = 0.0
    for f, name in enumerate(features.FEATURES):
        values = np.array([float(r[name]) for r in rows])[used]
        for border in blocks.edges[f]:
            left = values <= border
            if min(left.sum(), (~left).sum()) >= params.min_data_in_leaf:
                gain = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum()
                best = max(best, gain)
    assert tree.gain[0] == pytest.approx(best, rel=1e-4)


def pair_accuracy(scores, frame) -> float:
    rows = frame.select("customer_id", "item_id", "label").join(scores, ["customer_id", "item_id"]).toPandas()
    right = total = 0.0
    for _, group in rows.groupby("customer_id"):
        gap = group.loc[group.label == 1, "score"].to_numpy()[:, None] - group.loc[group.label == 0, "score"].to_numpy()[None, :]
        right, total = right + (gap > 0).sum() + 0.5 * (gap == 0).sum(), total + gap.size
    return right / total


def test_ranker_learns_and_scores_like_its_trees(data):
    model = ranker.train_ranker(data.train, SMALL)
    assert pair_accuracy(ranker.score_frame(model, data.train), data.train) > 0.6
    blocks = boosting.binned_blocks(data.train, features.FEATURES, SMALL.seed)
    trees = boosting.boost(blocks, [SMALL])[0]
    wanted = scores_of_trees(trees, data.evaluation, blocks.edges)
    found = {(r.customer_id, r.item_id): r.score for r in ranker.score_frame(model, data.evaluation).collect()}
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k], abs=1e-9) for k in found)
    top = ranker.predict_ranker(model, data.evaluation, 10)
    assert top.groupBy("customer_id").count().filter("count <> 10").count() == 0


def test_importance_equals_sql_over_the_stored_nodes(spark, data):
    key = uuid.uuid4().hex
    model = ranker.train_ranker(data.train, SMALL, key)
    path = kept_folder(spark, "ranker-model", ranker.model_key(key, SMALL)).removeprefix("file:")
    rows = duckdb.sql(f"SELECT feature, sum(gain), count(*) FROM '{path}/*/*.parquet' WHERE feature IS NOT NULL GROUP BY feature").fetchall()
    wanted = {features.FEATURES[f]: (pytest.approx(gain), n) for f, gain, n in rows}
    found = {r.feature: (r.gain, r.splits) for r in model.importance().collect()}
    assert len(found) == 29 and len(wanted) > 3
    assert all(found[name] == wanted.get(name, (0.0, 0)) for name in found)


def test_models_and_trials_are_made_once(data, monkeypatch):
    key = uuid.uuid4().hex
    trials = [("default", SMALL), ("other", replace(SMALL, num_leaves=4)), ("more", replace(SMALL, num_boost_round=8))]
    first = ranker.train_ranker(data.train, SMALL, key)
    trained, true = [], boosting.boost
    monkeypatch.setattr(ranker, "boost", lambda blocks, group, done: trained.append(group) or true(blocks, group, done))
    results, best = ranker.tune(data.train, data.evaluation, data.eval_truth, 10, trials, key)
    assert trained == [[trials[1][1], trials[2][1]]]  # the search goes on with what is missing
    again, best_again = ranker.tune(data.train, data.evaluation, data.eval_truth, 10, trials, key)
    assert len(trained) == 1 and again == results
    assert collected(best_again.nodes) == collected(best.nodes)
    leader = max(r.metrics["map_at_k"] for r in results)
    reached = ranker.ranking_metrics(ranker.predict_ranker(best, data.evaluation, 10), data.eval_truth, 10).first()
    assert reached.map_at_k == leader
    fresh = ranker.train_ranker(data.train, SMALL)
    assert collected(ranker.score_frame(first, data.evaluation)) == collected(ranker.score_frame(fresh, data.evaluation))


def test_kept_tables_need_a_finished_folder(spark):
    key, made = uuid.uuid4().hex, []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert kept(spark, "test", key, lambda: make(3)).count() == 3
    assert kept(spark, "test", key, lambda: make(4)).count() == 3
    assert kept(spark, "test", "", lambda: make(5)).count() == 5 and kept(spark, "test", "", lambda: make(6)).count() == 6
    spark.range(9).write.parquet(f"{kept_folder(spark, 'test', key + 'x')}/half")
    from pathlib import Path

    marker = Path(kept_folder(spark, "test", key + "x").removeprefix("file:")) / "half" / "_SUCCESS"
    marker.rename(marker.with_name("_GONE"))
    assert kept(spark, "test", key + "x", lambda: make(7)).count() == 7
    assert made == [3, 5, 6, 7]


def test_report_has_every_section(spark, data):
    tables = replace(star_tables(spark, "/root/testdata/sf0.001", S.CUTOFF, "style"), source_key="")
    trials, model = ranker.tune(data.train, data.evaluation, data.eval_truth, 10, [("default", SMALL)])
    rows = ranker.ranker_report(tables, WINDOWS, data, trials, model, 10, S.EVENT_START).collect()
    by_section = {s: [r for r in rows if r.section == s] for s in {r.section for r in rows}}
    assert {s: len({r.name for r in rs}) for s, rs in by_section.items()} == {"candidates": 2, "comparison": 2, "trial": 1, "importance": 29}
    values = {(r.section, r["name"], r.measure): r.value for r in rows}
    assert values[("trial", "default", "map_at_k")] == values[("comparison", "ranker", "map_at_k")]


@pytest.mark.parametrize("name", ["ranker_recs", "ranker_importance", "ranker_vs_hybrid", "ranker_tuning", "ranker_report"])
def test_ranker_queries_use_full_settings(monkeypatch, name):
    class Used(Exception):
        pass

    def train(frame, params, key):
        raise Used(list(params))

    monkeypatch.setattr(queries, "_ranker_data", lambda spark, folder: (None, ranker.RankerData(None, None, None, None)))
    monkeypatch.setattr(ranker, "train_rankers", train)
    with pytest.raises(Used) as used:
        queries.QUERIES[name](None, "")
    first, *rest = used.value.args[0]
    assert first == ranker.RankerParams() and len(set(rest)) == len(rest)
    assert all(getattr(params, key) in choices for params in rest for key, choices in ranker.TUNING_GRID.items())
    assert len(rest) > 1 if name in ("ranker_tuning", "ranker_report") else not rest


def test_tuning_draws_are_seeded():
    first = ranker.tuning_trials(ranker.RankerParams(), 3)
    assert first == ranker.tuning_trials(ranker.RankerParams(), 3)
    assert first[0] == ("default", ranker.RankerParams())
    assert all(params.num_leaves in ranker.TUNING_GRID["num_leaves"] for _, params in first[1:])


def test_features_move_once(spark):
    """With stored inputs, the frame's rows are moved once, by customer, and looked up by item."""
    tables = replace(star_tables(spark, "/root/testdata/sf0.001", S.CUTOFF, "style"), source_key="")
    cfg = features.CandidateConfig(event_start=S.EVENT_START)
    inputs = features.ranker_inputs(tables, S.CUTOFF, ranker.buyers(tables.transactions, S.CUTOFF, S.VALID_END))
    rows = materialize(features.candidate_rows(inputs, cfg), "test-candidates")
    merged = materialize(features.build_candidates(inputs, cfg), "test-candidates")
    stored = replace(tables, transactions=materialize(tables.transactions, "test-tx"), events=materialize(tables.events, "test-ev"))
    frames = [features.feature_frame(replace(inputs, tables=stored), c, S.VALID_END, cfg) for c in (rows, merged)]
    assert collected(frames[0]) == collected(frames[1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = features.feature_frame(replace(inputs, tables=stored), rows, S.VALID_END, cfg)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan


def test_only_smaller_children_are_counted(monkeypatch):
    """A level reads at most half of the rows again, and the sums left to the larger children are exact."""
    dice = np.random.default_rng(5)
    rows, depth = 4_000, 5
    bins = dice.integers(0, 40, (3, rows)).astype(np.uint8)
    g, h = dice.integers(-(10**6), 10**6, rows) + bins[1].astype(np.int64) * 10_000, dice.integers(1, 10**6, rows)
    growth = boosting._Growth([0, 1, 2], 10_000, depth, 32, 0.0, 1)
    counted, true = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda bins, node, *rest: counted.append(len(node)) or true(bins, node, *rest))
    found = boosting._subtree(bins, g, h, growth, 1, [40, 40, 40])
    assert len(counted) == depth and counted[0] == rows and all(n <= rows // 2 for n in counted[1:])
    inside = {1: np.arange(rows)}
    for path in sorted(found):
        split, mine = found[path], inside[path]
        left = bins[split.feature, mine] <= split.bin
        assert (split.all_g, split.all_h, split.all_n) == (g[mine].sum(), h[mine].sum(), len(mine))
        assert (split.g, split.h, split.n) == (g[mine][left].sum(), h[mine][left].sum(), left.sum())
        inside[2 * path], inside[2 * path + 1] = mine[left], mine[~left]
    assert len(found) > 8


def test_features_counted_together_give_the_same_sums():
    rng = np.random.default_rng(8)
    widths, rows = [3, 64, 2, 40, 64, 5, 1], 9_000
    bins = np.stack([rng.integers(0, w, rows) for w in widths]).astype(np.uint8)
    g, h, node = rng.integers(-(10**9), 10**9, rows), rng.integers(1, 10**8, rows), rng.integers(0, 3, rows)
    chosen = [0, 1, 2, 4, 5, 6]
    packs = boosting._Packs.of(bins, chosen, widths)
    assert len(packs.members) < len(chosen) and all(math.prod(w) <= boosting.PACKED for w in packs.widths)
    some = np.flatnonzero(rng.random(rows) < 0.6)
    for mine in (np.arange(rows), some):
        wanted = boosting._sums(bins[:, mine], node[mine], g[mine], h[mine], chosen, 3)
        assert (packs.sums(mine, node[mine], g[mine], h[mine], 3) == wanted).all()


def test_small_rounds_are_one_job_and_store_nothing_between(spark, data, monkeypatch):
    """A round adds the trees since the stored state; only rounds with large nodes cache a table of their own."""
    monkeypatch.setattr(boosting, "STORE_EVERY", 4)
    blocks = boosting.binned_blocks(data.train, features.FEATURES, 42)
    held, kind = [], type(blocks.rows)
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *args: held.append(self) or persist(self, *args))
    small = boosting.boost(blocks, [SMALL])
    assert len(held) == 2
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    large = boosting.boost(blocks, [SMALL])
    assert len(held) == 2 + 2 + SMALL.num_boost_round
    assert boosting.node_rows(large[0], blocks.edges) == boosting.node_rows(small[0], blocks.edges)


def test_kept_frames_need_no_inputs(spark, monkeypatch):
    tables = replace(star_tables(spark, "/root/testdata/sf0.001", S.CUTOFF, "style"), source_key=uuid.uuid4().hex)
    first = ranker.ranker_data(tables, WINDOWS, features.CandidateConfig(event_start=S.EVENT_START))

    def refuse(*_):
        raise AssertionError("inputs of a frame that is there")

    monkeypatch.setattr(ranker, "ranker_inputs", refuse)
    again = ranker.ranker_data(tables, WINDOWS, features.CandidateConfig(event_start=S.EVENT_START))
    for name in ("train", "evaluation", "eval_customers", "eval_truth"):
        assert collected(getattr(again, name)) == collected(getattr(first, name)) != []


def test_rounds_of_small_frames_share_a_job(spark, data, monkeypatch):
    """One job grows the trees of all rounds up to the next stored state, and they are those of the other ways."""
    blocks = boosting.binned_blocks(data.train, features.FEATURES, 42)
    settings = [replace(SMALL, num_boost_round=n, bagging_fraction=b) for n, b in ((7, 0.5), (3, 1.0), (1, 0.0))]
    jobs, kind = [], type(blocks.rows)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: jobs.append(self) or collect(self))
    monkeypatch.setattr(boosting, "STORE_EVERY", 4)
    ended = []
    found = boosting.boost(blocks, settings, lambda k, trees: ended.append((k, len(trees))))
    assert len(jobs) == 2 and sorted(ended) == [(0, 7), (1, 3), (2, 1)]
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    wanted = boosting.boost(blocks, settings)
    assert len(jobs) > 9
    assert [boosting.node_rows(t, blocks.edges) for t in found] == [boosting.node_rows(t, blocks.edges) for t in wanted]
    assert len(found[2][0].value) == 1  # nothing was drawn
