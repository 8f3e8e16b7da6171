from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from rebuy.llm import lexical_search
from rebuy.llm.common import words_of
from tests.llm.helpers import awkward, docs_table, prose

ITEMS = "item_id bigint, text string, doc_id bigint, score long, rank string"


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "clash") for i, t in rows], ITEMS)


def brute(rows, items, top=20):
    bags = [(i, Counter(words_of(t))) for i, t in rows]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item_id, text in items:
        scored = []
        for (doc_id, bag), n in zip(bags, sizes):
            if not n:
                continue
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t, k in Counter(words_of(text)).items()
                if bag[t]
            )
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:top], 1):
            out[(item_id, rank, doc_id, -score)] += 1
    return out


def case():
    rng = random.Random(8)
    rows = awkward(6)
    items = [(i, prose(rng, 25)) for i in range(8)] + [(8, rows[0][1]), (9, "ba ba ba CE"), (10, ""), (11, None), (12, "unheard-of zyx"), (None, prose(rng, 9)), (3, prose(rng, 12)), (9, "ba ba ba CE")]
    rows += [(500 + k, f"{prose(rng, rng.randint(5, 80))} {items[k % 8][1]}") for k in range(40)]
    rows += [(700 + k, items[2][1]) for k in range(45)]  # ties over the last rank
    return rows, items


def ranked(frame):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("tree, queries, sample", [(4096, 512, 8192), (32, 3, 40), (1, 512, 0)])
def test_ranks_match_brute_force(spark, monkeypatch, tree, queries, sample):
    monkeypatch.setattr(lexical_search, "TREE", tree)
    monkeypatch.setattr(lexical_search, "QUERIES", queries)
    monkeypatch.setattr(lexical_search, "SAMPLE", sample)
    rows, items = case()
    assert ranked(lexical_search.search(docs_table(spark, rows), items_table(spark, items))) == brute(rows, items)


def test_a_few_ranks_and_empty_tables(spark):
    rows, items = case()
    assert ranked(lexical_search.search(docs_table(spark, rows), items_table(spark, items), top=2)) == brute(rows, items, 2)
    assert lexical_search.search(docs_table(spark, []), items_table(spark, items)).count() == 0
    assert lexical_search.search(docs_table(spark, [(1, None), (2, "...")]), items_table(spark, items)).count() == 0
    found = lexical_search.search(docs_table(spark, rows), items_table(spark, []))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def random_matrix(rng, rows, terms, topics=6):
    lists = []
    for _ in range(rows):
        topic = rng.integers(topics)
        mine = set(rng.integers(0, 10, 4)) | set(10 + topic * (terms // topics) + rng.integers(0, terms // topics, 12))
        lists.append(sorted(mine))
    ends = np.cumsum([0] + [len(r) for r in lists])
    return ends, np.array([t for r in lists for t in r]), rng.integers(1, 1_000_000, ends[-1])


def test_tree_search_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    ends, terms, values = random_matrix(rng, 1500, 240)
    tree = lexical_search.build_tree(ends, terms, values)
    leaves = [rows for rows, first in zip(tree.rows, tree.first) if not first]
    assert sorted(np.concatenate(leaves)) == list(range(1500))
    matrix = (ends, np.searchsorted(tree.present, terms), values)
    ranks = rng.permutation(1500)
    visited = 0
    for _ in range(40):
        ids = np.sort(rng.choice(250, 12, replace=False))
        q = (ids, rng.integers(0, 9000, 12))
        dense = np.zeros(300, np.int64)
        dense[ids] = q[1]
        sums = np.add.reduceat(dense[terms] * values, ends[:-1])
        wanted = sorted((-s, ranks[i]) for i, s in enumerate(sums) if s > 0)[:20]
        rows, scores, scored = lexical_search.search_tree(tree, matrix, ranks, q, 20, 0)
        assert sorted((-s, ranks[i]) for i, s in zip(rows, scores))[:20] == wanted
        visited += scored
    assert visited < 0.8 * 40 * len(leaves)


def test_bounds_cover_every_row():
    rng = np.random.default_rng(3)
    ends, terms, values = random_matrix(rng, 300, 60)
    tree = lexical_search.build_tree(ends, terms, values, leaf=4)
    dense = np.zeros((300, len(tree.present)))
    dense[np.repeat(np.arange(300), np.diff(ends)), np.searchsorted(tree.present, terms)] = values
    for _ in range(30):
        q = rng.integers(0, 5000, len(tree.present)) * (rng.random(len(tree.present)) < 0.2)
        ball = q @ tree.centroid + math.sqrt(q @ q) * tree.radius
        box = q @ tree.reach
        for node, rows in enumerate(tree.rows):
            assert min(ball[node], box[node]) * (1 + lexical_search.SAFE) + 1 >= (dense[rows] @ q).max()


def test_equal_rows_make_one_leaf():
    ends = np.arange(0, 2002, 2)
    tree = lexical_search.build_tree(ends, np.tile([1, 5], 1000), np.tile([10, 20], 1000))
    assert tree.first == [0] and tree.radius[0] == 0


def test_long_texts_are_counted_in_stretches(monkeypatch):
    monkeypatch.setattr(lexical_search, "STRETCH", 30)
    text = "ab Cd\nef, " * 50 + "x" * 200 + " end"
    assert lexical_search._counted(text) == (len(words_of(text)), Counter(words_of(text)))
