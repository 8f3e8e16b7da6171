from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from rebuy.llm import spelling
from tests.llm.helpers import awkward, docs_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, modulus, min_length=6):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = None if doc_id is None else zlib.crc32(f"{doc_id}:{word}".encode())
            if h is not None and h % modulus == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_length:
                counts[word] += 1
    return counts


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, min_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def vocabulary(rng, size=260):
    """Words with shared beginnings and ends, some long, some one edit apart in chains of counts."""
    words = {}
    while len(words) < size:
        w = rng.choice(["abcdef", "straße", "anticip", "zzzzzz", "über"]) + "".join(rng.choice("abÿé") for _ in range(rng.randint(2, 7)))
        words[w] = rng.choice([5, 5, 6, 25, 30, 130, 700])
        k = rng.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + rng.choice("abx") + w[k:], w[:k] + "q" + w[k + 1 :]):
            if rng.random() < 0.5 and len(v) >= 6:
                words[v] = rng.choice([4, 5, 26, 200])
    words["ab" * 400] = 5
    words["ab" * 399 + "b"] = 25
    words["aaaaaa"], words["aaaaaaa"], words["aaaaaaaa"], words["aaaaaaaaa"] = 5, 25, 125, 625
    return words


@pytest.mark.parametrize("block", [1, 7, 512])
def test_near_words_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = {w: n for w, n in vocabulary(random.Random(3)).items() if n >= 5}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.near_words(frame).collect()}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    best = {w: min(o, key=lambda v: (-words[v], v)) for w, o in near.items() if o}
    assert rows == {w: (len(near[w]), b, words[b]) for w, b in best.items()}
    assert len(rows) > 100


def test_variants_match_brute_force(spark):
    rng = random.Random(4)
    rows = awkward(2)
    bag = [w for w, n in vocabulary(rng, 120).items() for _ in range(min(n, 200))]
    rng.shuffle(bag)
    cut = [bag[i : i + 90] for i in range(0, len(bag), 90)]
    rows += [(1000 + i, rng.choice([" ", ", ", "1", "Ā", "\n"]).join(part).title()) for i, part in enumerate(cut)]
    rows += [(None, "abcdefab abcdefaq " * 6), (5000, "÷×÷×÷×÷ " * 6), (5000, "÷×÷×÷×÷ ")]
    rows += [(None, f"{'k' * (7 + i)} " * 5 ** (1 + i)) for i in range(4)]
    wanted = brute(brute_counts(rows, 199))
    assert found(spelling.variants(docs_table(spark, rows), modulus=199)) == wanted
    assert any(f is not None for f, *_ in wanted.values()) and wanted["k" * 7][:2] == ("k" * 8, "k" * 10)


def test_damage_and_stretches(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 50)
    text = "Wörter und Ähnliches; ābc " * 40 + "x" * 300
    joined = b" ".join(p for part in spelling.stretches(text) for p in part.split())
    assert joined.decode("latin-1").split() == [("".join(c.lower() if c.isascii() else c for c in r)) for r in RUN.findall(text)]
    hits = [w for i in range(20_000) if (w := spelling.damaged(b"stra\xdfe", zlib.crc32(f"{i}:".encode()), 199)) != b"stra\xdfe"]
    assert 60 < len(hits) < 150 and {len(w) for w in hits} == {5}


def test_workers_hand_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = awkward(2)
    counts = {r.word: r.n for r in spelling.word_counts(docs_table(spark, rows), modulus=199).collect()}
    assert counts == dict(brute_counts(rows, 199))


def test_nothing_to_compare(spark):
    assert found(spelling.variants(docs_table(spark, []), modulus=199)) == {}
    assert found(spelling.variants(docs_table(spark, [(1, None), (2, ""), (3, "short words")]))) == {}
    assert found(spelling.variants(docs_table(spark, [(1, "lonely " * 5)]))) == {"lonely": (None, "lonely", 5, 0, None)}
