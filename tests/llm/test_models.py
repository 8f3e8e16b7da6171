from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebuy.llm import language_id, quality, toxicity
from rebuy.llm.common import crc32_bucket
from rebuy.llm.queries import QUERIES
from tests.llm.helpers import awkward, docs_table, prose

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


# A tenth of the documents labelled toxic hold nothing to learn from, so not all can be found.
@pytest.mark.parametrize(
    ("name", "label", "ones", "zeros"), [("op1_quality_rules", "quality", 0.95, 0.95), ("op8_toxicity_crf", "toxic", 0.75, 0.98)]
)
def test_held_out_recall_of_both_labels(spark, name, label, ones, zeros):
    found = QUERIES[name](spark, FOLDER).filter("held_out")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(f"{label} is not null")
    rows = found.join(labels, "doc_id").select(F.col(label).alias("y"), "predicted").collect()
    for value, least in ((1, ones), (0, zeros)):
        mine = [r.predicted == value for r in rows if r.y == value]
        assert len(mine) > 5 and sum(mine) / len(mine) >= least


def test_sentences_are_scored_whole():
    words = ["vile"] * 3 + ["w" + "abcdefghij"[k % 10] * (k % 7) for k in range(500)]
    assert toxicity.sentences(" ".join(words)) == [words]
    model = toxicity.Model(start=-2.0)
    model.transitions[:] = [[0.5, -1.0], [-0.5, 1.5]]
    model.weights[toxicity.own_slots("vile")[0]] = 3.0
    found = toxicity.token_marginals([[words], [words[:10]]], model, model.parts())
    # The plain recurrence over all 503 tokens.
    lift = [math.exp(sum(float(model.weights[k]) for k in toxicity.own_slots(w))) for w in words]
    move = np.exp(model.transitions)
    forward = [np.array([1.0, math.exp(model.start) * lift[0]])]
    for x in lift[1:]:
        step = forward[-1] @ move * np.array([1.0, x])
        forward.append(step / step.sum())
    back = [np.ones(2)]
    for x in reversed(lift[1:]):
        step = move @ (np.array([1.0, x]) * back[-1])
        back.append(step / step.sum())
    plain = [(f * b)[1] / (f @ b) for f, b in zip(forward, reversed(back))]
    assert np.allclose(found[0][0], plain, atol=1e-9) and len(found[1][0]) == 10


def test_languages_are_told_apart(spark):
    found = QUERIES["op6_language_id"](spark, FOLDER).filter("held_out")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


# --- quality --------------------------------------------------------------------------------


def labelled(spark, n=240):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(rng, 60)
        rows.append((i, text.upper().replace(" ", " ### ") if bad else text))
        labels.append((i, 0 if bad else 1))
    labels += [(None, 1), (5, None), (9999, 0)]
    return docs_table(spark, rows + awkward()[20:]), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_rules_are_sparse_and_compile(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels, crc32_bucket(F.col("doc_id"), 5) != 0)
    assert 0 < len(model.rules) < 60
    assert all(sign in ("<=", ">") and name in quality.ratios() for rule, _ in model.rules for name, sign, _ in rule)
    scored = quality.score(docs, model, "text", [F.col("doc_id"), F.col("label").alias("words")])
    assert scored.columns == ["doc_id", "words", "score"]
    rows = scored.collect()
    assert len(rows) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    good = {r.doc_id: r.score for r in rows if r.doc_id is not None and r.doc_id < 20}
    assert good[4] < 0.3 < good[5]
    # No Python in the plan.
    assert "Python" not in scored._jdf.queryExecution().toString() and "Arrow" not in scored._jdf.queryExecution().toString()


def plain_score(text, model):
    """Statistics, rules and score of one text in plain Python."""
    import re
    import unicodedata

    text = text or ""
    words = [w for w in re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    parts = [x for x in re.split(r"[.!?\n]+[ \t\n\x0b\f\r]*", text) if x]
    kind = [unicodedata.category(c) for c in text]
    symbols = sum(k[0] not in "LN" and c not in " \t\n\x0b\f\r.,;:?'\"()-" for c, k in zip(text, kind))
    over = lambda a, b: a / b if b else 0.0
    n = len(words)
    known = {
        "log_words": math.log(n + 1),
        "word_length": over(len(text), n),
        "sentence_length": over(n, len(parts)),
        "line_length": over(n, len(lines)),
        "word_variety": over(len(set(words)), n),
        "word_growth": math.log(max(1, len(set(words)))) / math.log(n) if n > 1 else 1.0,
        "line_variety": over(len(set(lines)), len(lines)),
        "sentence_variety": over(len(set(parts)), len(parts)),
        "capital_share": over(kind.count("Lu"), len(text)),
        "symbol_share": over(symbols, len(text)),
        "stop_rate": over(sum(c in ".,;:?" for c in text), n),
        "digit_share": over(sum(c in "0123456789" for c in text), len(text)),
    }
    total = model.intercept
    for rule, weight in model.rules:
        if all(known[name] <= v if sign == "<=" else known[name] > v for name, sign, v in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_scores_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(docs_table(spark, awkward()).select("doc_id", "text"))
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), F.lit(True))
    assert model.rules
    for row in quality.score(docs, model, "text", [F.col("text")]).collect():
        assert row.score == pytest.approx(plain_score(row.text, model), abs=1e-9)


def test_kept_names_clash_with_no_statistic(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels, F.lit(True))
    names = [*quality.statistics(F.col("text")), *quality.ratios(), "kept", "counted"]
    kept = [F.lit(k).alias(name) for k, name in enumerate(names)]
    found = quality.score(docs, model, "text", kept)
    assert found.columns == [*names, "score"]
    assert sorted(r.score for r in found.collect()) == sorted(r.score for r in quality.score(docs, model, "text", [F.col("doc_id")]).collect())


def test_quality_without_labels(spark):
    docs, labels = labelled(spark, 8)
    nothing = quality.train(docs, labels.filter("false"), F.lit(True))
    assert {round(r.score, 6) for r in quality.score(docs, nothing, "text", [F.col("doc_id")]).collect()} == {0.5}
    empty = docs.filter("false")
    assert quality.score(empty, quality.train(empty, labels, F.lit(True)), "text", [F.col("doc_id")]).count() == 0


def test_statistics_of_an_empty_text(spark):
    row = spark.createDataFrame([(None,), ("",), ("  \n ",)], "t string").select(*[c.alias(n) for n, c in quality.statistics(F.col("t")).items()]).collect()
    assert all(v == 0 for v in row[0]) and all(v == 0 for v in row[1])
    assert row[2].words == row[2].lines == 0


# --- languages ------------------------------------------------------------------------------


def test_all_segmentations_are_summed():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    known = language_id.beginnings(pieces)
    rng = np.random.default_rng(4)
    tables = rng.random((2, len(pieces) + 1)).tolist()

    def brute(text, language):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            parts, start = [], 0
            for k, cut in enumerate(cuts, 1):
                if cut:
                    parts.append(text[start:k])
                    start = k
            parts.append(text[start:])
            if all(known.get(p, -1) >= 0 for p in parts):
                total += math.prod(tables[language][known[p]] for p in parts)
        return total

    found = language_id.log_probability("abab", known, tables)
    assert [round(x, 9) for x in found] == [round(math.log(brute("▁abab", k)), 9) for k in (0, 1)]
    # Expected counts: each segmentation weighs as much as its share of the sum.
    probability = np.array(tables[0])
    used = language_id.expected_counts({"ab": 3}, known, probability)
    ways = {("▁", "a", "b"): 0, ("▁", "ab"): 0, ("▁a", "b"): 0, ("▁ab",): 0}
    for way in ways:
        ways[way] = math.prod(tables[0][known[p]] for p in way)
    wanted = Counter()
    for way, weight in ways.items():
        for p in way:
            wanted[p] += 3 * weight / sum(ways.values())
    assert all(abs(used[known[p]] - wanted[p]) < 1e-9 for p in pieces)


def test_words_are_letters_with_their_marks():
    assert language_id.words("½ ² ³ Ⅷ ① 12 ٣ _ -- \u0301") == []
    assert language_id.words("हिंदी में 12 Straße, TARİHİ aªb µm×n x_y") == ["हिंदी", "में", "straße", "tari̇hi̇", "aªb", "µm", "n", "x", "y"]
    assert language_id.words("É÷é Ÿ") == ["é", "é", "ÿ"]
    pieces = language_id.vocabulary_pieces(language_id.default_vocabulary())
    assert max(map(len, pieces)) > 8


def test_long_words_are_summed_whole(monkeypatch):
    pieces = language_id.vocabulary_pieces(language_id.default_vocabulary())[:6000]
    known = language_id.beginnings(pieces)
    rng = np.random.default_rng(5)
    tables = (rng.random((2, len(pieces) + 1)) * 1e-3 + 1e-9).tolist()
    letters = sorted({c for p in pieces for c in p} - {"▁"})
    long = "".join(rng.choice(letters, 200))
    found = language_id.log_probability(long, known, tables)
    # The plain recurrence, in whole fractions.
    from fractions import Fraction

    for k, table in enumerate(tables):
        marked, sums = "▁" + long, [Fraction(1)]
        for end in range(1, len(marked) + 1):
            here = Fraction(0)
            for start in range(end):
                piece = marked[start:end]
                number = known.get(piece, -1)
                if number >= 0 or end - start == 1:
                    here += sums[start] * Fraction(table[number])
            sums.append(here)
        assert found[k] == pytest.approx(math.log(sums[-1].numerator) - math.log(sums[-1].denominator), rel=1e-9)
    probability = np.array(tables[0])
    words = {"".join(rng.choice(letters[:30], 25)): 2, "abab" * 5: 3}
    plain = language_id.log_probability("abab" * 5, known, tables), language_id.expected_counts(words, known, probability)
    monkeypatch.setattr(language_id, "LINEAR", 0)
    logs = language_id.log_probability("abab" * 5, known, tables), language_id.expected_counts(words, known, probability)
    assert np.allclose(plain[0], logs[0]) and np.allclose(plain[1], logs[1])


def test_texts_without_letters_have_no_language(spark):
    rows = [(1, "the cat of the house"), (2, "la casa del gato"), (3, "½"), (4, "² ³"), (5, "Ⅷ ①"), (6, "٣ 12"), (7, "x" * 5000)]
    docs = docs_table(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 2, "es"))
    model = language_id.train(docs, F.lit(True), language_id.default_vocabulary())
    found = {r.doc_id: r.lang_pred for r in language_id.predict(spark, docs, model).collect()}
    assert [found[i] for i in range(1, 7)] == ["en", "es", "und", "und", "und", "und"] and found[7] in ("en", "es")


def test_language_of_awkward_texts(spark):
    rows = awkward()
    docs = docs_table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") < 60, "bb"))
    model = language_id.train(docs, F.lit(True), language_id.default_vocabulary())
    found = language_id.predict(spark, docs, model).collect()
    assert len(found) == len(rows)
    for row, (_, text) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang_pred)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        assert row.lang_pred in ("aa", "bb", "und") and 0 <= row.score <= 1
    unknown = {(r.doc_id, r.score) for r in found if r.lang_pred == "und"}
    assert unknown == {(60, 0.0), (61, 0.0), (62, 0.0), (63, 0.0), (None, 0.0)}


def test_languages_of_few_copied_texts_are_learned(spark):
    """1,000 rows of two texts in each of 12 languages, and a hot text that is one of 30."""
    letters = "abcdefghijkl"
    rows = [(f"l{k}", f"{c}{c}x {c}o{c} " * 20 + f"{c}{i % 2}") for k, c in enumerate(letters) for i in range(1000)]
    rows += [("hot", "zuz vuv " * 20)] * 3000 + [("hot", f"ziz {'y' * (1 + k)} yiy") for k in range(29)]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id bigint, lang string, text string")
    seen: dict[str, dict[str, int]] = {}

    def fit(counts, pieces, true=language_id.fit):
        for row in counts.collect():
            seen.setdefault(row["lang"], {})[row["word"]] = row["n"]
        return true(counts, pieces)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "fit", fit)
        model = language_id.train(docs, F.lit(True), language_id.default_vocabulary())
    assert model[0] == sorted({lang for lang, _ in rows})
    assert seen["hot"]["zuz"] == 20 and seen["hot"]["yiy"] == 29  # each text once
    found = language_id.predict(spark, docs, model, keep=("doc_id", "lang"))
    assert found.filter("lang != lang_pred").count() == 0


def test_language_without_anything_to_learn(spark):
    docs = docs_table(spark, [(1, "some words"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    model = language_id.train(docs, F.lit(True), language_id.default_vocabulary())
    assert {r.lang_pred for r in language_id.predict(spark, docs, model).collect()} == {"und"}
    assert language_id.predict(spark, docs.filter("false"), model).count() == 0


# --- toxicity -------------------------------------------------------------------------------


def test_marginals_match_enumeration():
    rng = np.random.default_rng(6)
    transitions, start = rng.normal(size=(2, 2)), 0.4
    potential, lengths = rng.normal(size=(3, 5)), np.array([5, 3, 1])
    found = toxicity.marginals(potential, lengths, transitions, start)
    pairs = np.zeros((2, 2))
    for row in range(3):
        n, total, each = lengths[row], 0.0, np.zeros(lengths[row])
        moves = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            weight = start * path[0] + sum(potential[row, t] * s for t, s in enumerate(path))
            weight = math.exp(weight + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += weight
            each += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                moves[a, b] += weight
        assert np.allclose(found[row, :n], each / total) and not found[row, n:].any()
        pairs += moves / total
    assert np.allclose(toxicity._pair_marginals(potential, lengths, transitions, start), pairs)


def test_lower_case_of_whole_texts_is_that_of_words():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in "\u0130\u03a3"]
    for pattern in (toxicity._WORD, toxicity._END):
        assert all(len(c.lower()) == 1 and bool(pattern.fullmatch(c)) == bool(pattern.fullmatch(c.lower())) for c in every if c.lower() != c)
    text = "Some WORDS'S É\u0301 x1Y_Z. ΑΣ'Α ΟΔΟΣ İstanbul!\n\nŞİ Ⅷ ǅ"
    for t in (text, text.replace("Σ", "").replace("İ", ""), "...", "", None):
        split = [[w.lower() for w in toxicity._WORD.findall(part)] for part in toxicity._END.split(t or "")]
        assert toxicity.sentences(t) == [words for words in split if words]


def test_remembered_words_are_packed():
    slots = lambda *names: [zlib.crc32(n.encode()) % toxicity.WEIGHTS for n in names]
    model = toxicity.Model(weights=np.random.default_rng(2).normal(size=toxicity.WEIGHTS).astype(np.float32))
    memo = model.parts()
    for word in ("a", "abc", "abcd", "abcdefgh", "abcdefghijk", "éàêüß", "한국어한국어"):
        own = slots(f"o{word}", *(f"o^{word[:n]}" for n in range(3, 9) if len(word) > n), f"o{word[-3:]}$", "oany")
        assert toxicity.own_slots(word) == own
        expected = [sum(float(model.weights[k]) for k in own), *(float(model.weights[k]) for k in slots(f"p{word}", f"n{word}"))]
        assert isinstance(memo[word], bytes) and np.allclose(np.frombuffer(memo[word]), expected, rtol=0, atol=1e-12)


def toxic_sample(n=300):
    rng = random.Random(3)
    insults = ["vermox", "grumpo"] + [f"sklarn{x}" for x in ("a", "ei", "out", "ig", "u", "on")]
    out = []
    for i in range(n):
        words = prose(rng, 80).split()
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(insults)
        out.append((" ".join(words), int(i % 5 == 0)))
    return out


def test_spans_and_scores(spark):
    model = toxicity.fit(toxic_sample())
    text = "Ba ce di. You vermox fo, gu Sklarnix ra!\nLe mi grumpo no."
    rows = awkward() + [(900, text), (901, "Ba ce di fo gu. Ra le mi no.")]
    found = toxicity.score(spark, docs_table(spark, rows), model, with_spans=True).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert [text[s.start : s.end] for s in by_id[900].spans] == ["vermox", "Sklarnix", "grumpo"]
    assert by_id[900].score >= 0.7 > by_id[901].score
    assert by_id[60].score < 0.5 and not by_id[60].spans


def test_toxicity_without_both_labels(spark):
    docs = docs_table(spark, [(1, "some words"), (2, None)])
    for sample, share in (([], 0.0), ([("a", 1)], 1.0), ([("a", 0)], 0.0)):
        scores = [r.score for r in toxicity.score(spark, docs, toxicity.fit(sample)).collect()]
        assert all(abs(s - share) < 1e-6 for s in scores)
    assert toxicity.score(spark, docs.filter("false"), toxicity.fit([])).count() == 0
