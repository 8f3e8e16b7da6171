from __future__ import annotations

import random
from collections import Counter

import numpy as np

from rebuy.llm import components, decontamination, near_join
from rebuy.llm.common import words_of
from tests.llm.helpers import awkward, docs_table, prose, shingles

ITEMS = "item_id bigint, text string, doc_id bigint, token string"


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], ITEMS)


def brute_hits(text, items, window=13):
    words, hit, names = words_of(text), set(), set()
    for item_id, item in items:
        own = words_of(item)
        if not own:
            continue
        size = min(window, len(own))
        for k in range(len(own) - size + 1):
            wanted = own[k : k + size]
            for at in range(len(words) - size + 1):
                if words[at : at + size] == wanted:
                    hit.update(range(at, at + size))
                    names.add("null" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(names)


def contaminated_case():
    rng = random.Random(7)
    items = [(i, prose(rng, 30)) for i in range(6)]
    # Short, empty and null items, repeated words, the same passage twice, only frequent words.
    items += [(10, "ba ce di"), (11, "Ba. ce; DI fo"), (12, ""), (13, None), (14, "..."), (None, prose(rng, 20)), (15, items[0][1]), (16, "ba " * 20), (2, prose(rng, 16))]
    rows = awkward(3)
    for k in range(12):
        item = items[k % 6][1].split()
        a = rng.randint(0, 10)
        cut = item[a : a + rng.randint(10, 20)]
        rows.append((200 + k, f"{prose(rng, 40)} {' '.join(cut)} {prose(rng, 30)}"))
    rows += [(300, items[0][1]), (301, items[1][1].upper() + "\n" + items[1][1]), (302, "ba " * 40), (303, "ce ba ce di fo"), (304, items[5][1])]
    return rows, items


def test_contamination_matches_brute_force(spark):
    rows, items = contaminated_case()
    found = decontamination.find_contamination(docs_table(spark, rows), items_table(spark, items)).collect()
    wanted = Counter((i, *brute_hits(t, items)[:2], tuple(brute_hits(t, items)[2])) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == wanted
    assert all(r.n_items == len(r["items"]) for r in found)
    assert sum(r.n_hit > 0 for r in found) >= 8


def test_decontaminated_rows(spark):
    rows, items = contaminated_case()
    docs = docs_table(spark, rows)
    kept = decontamination.decontaminate(docs, items_table(spark, items))
    assert kept.columns == docs.columns
    bad = [(i, t) for i, t in rows if (h := brute_hits(t, items))[1] and 20 * h[1] >= h[0]]
    assert bad and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows) - Counter(bad)


def test_contamination_of_empty_tables(spark):
    rows, items = contaminated_case()
    assert decontamination.find_contamination(docs_table(spark, []), items_table(spark, items)).count() == 0
    clean = decontamination.find_contamination(docs_table(spark, rows), items_table(spark, []))
    assert clean.count() == len(rows) and clean.filter("n_hit > 0 or n_items > 0").count() == 0


def brute_groups(rows):
    """Group and links of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    group, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                    links[a] += 1
                    links[b] += 1
                    group[top(a)] = top(b)
    members = {}
    for k in range(len(rows)):
        members.setdefault(top(k), []).append(rows[k][0])
    least = {k: min((i for i in ids if i is not None), default=None) if None not in ids else None for k, ids in members.items()}
    return [least[top(k)] for k in range(len(rows))], links


def near_case(seed=5, copies=70):
    """Chains of edits around a few bases: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    rows = [(i, t) for i, t in awkward(4) if i is not None]
    text = prose(rng, 150).split()
    for k in range(copies):
        own = list(text)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"edit{rng.randint(0, 40)}"
        rows.append((400 + k, " ".join(own)))
        if k % 7 == 0:
            text = own
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_case()
    found = near_join.near_duplicates(docs_table(spark, rows)).collect()
    groups, links = brute_groups(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == Counter((i, g, n) for (i, _), g, n in zip(rows, groups, links))
    assert sum(n > 0 for n in links) > 40


def test_blocks_give_the_same_result(spark, monkeypatch):
    """Small blocks, as for groups that are too large for one task."""
    monkeypatch.setattr(near_join, "BAND_BLOCK", 7)
    monkeypatch.setattr(near_join, "GROUP_BLOCK", 5)
    monkeypatch.setattr(near_join, "SMALL", 4)
    rows = near_case(seed=6)
    found = near_join.near_duplicates(docs_table(spark, rows)).collect()
    groups, links = brute_groups(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == Counter((i, g, n) for (i, _), g, n in zip(rows, groups, links))


def test_one_of_each_group_stays(spark):
    rows = near_case(seed=8)
    docs = docs_table(spark, rows)
    kept = near_join.near_deduplicate(docs)
    assert kept.columns == docs.columns
    groups, _ = brute_groups(rows)
    wordless = sum(1 for _, t in rows if not shingles(t))
    seen = Counter()
    for (i, t), g in zip(rows, groups):
        if shingles(t):
            seen[g] += 1
    found = kept.collect()
    with_words = [r for r in found if shingles(r.text)]
    assert len(with_words) == len({(g, shingles(t) if g == 3 else None) for (_, t), g in zip(rows, groups) if shingles(t)})
    # Texts without words are linked to nothing; rows repeated with id and text count once.
    assert len(found) - len(with_words) == wordless


def test_near_duplicates_of_an_empty_table(spark):
    assert near_join.near_duplicates(docs_table(spark, [])).count() == 0
    assert near_join.near_duplicates(docs_table(spark, [(1, None), (2, "")])).filter("n_links > 0").count() == 0


def test_pruning_follows_the_posterior():
    needed = near_join.needed_matches()
    assert sorted(needed) == [32, 64, 96, 128]
    # The share of matches that is asked for rises with the number of values seen, and stays below the threshold.
    shares = [needed[n] / n for n in sorted(needed)]
    assert shares == sorted(shares) and shares[-1] < 0.8


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(9)]
    found = near_join.common_counts(sets, 4)
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            label[y] = x
    found = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()
    assert {r.node: r.comp for r in found} == {n: top(n) for n in label} and len(found) == len(label)
