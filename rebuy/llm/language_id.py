"""Language of a text by unigram pieces with all segmentations summed.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is
the sum, over all ways to cut it into pieces, of the products of their probabilities; a forward
pass along the word adds them up. A text's log probability is the sum over its words. Piece
probabilities are fitted by expectation-maximisation, where the expected piece counts come from a
forward-backward pass over the same sums.

The fit reads ``DOCUMENTS`` different texts of each language at most, each taken once and whole, with
all their words; its rounds are Spark aggregations over the counted words. Scoring reads every
text whole, every word whole and every segmentation; a worker remembers the probabilities of words it has seen.

A word is a letter with the letters and combining marks that follow it (Unicode categories L and M).

Defined cases: ``und`` with score 0 for a null text or one without a letter. Languages are the
values of the language column that may be learned from; without any, every text is ``und``.
Upper case counts as lower case. A character that is in no piece has a small fixed probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rebuy.llm.common import Memo, partitions_of, worker_state
from rebuy.session import materialize

DOCUMENTS = 400
ROUNDS = 3
UNKNOWN = 1e-7  # probability of a character that is in no piece
SMOOTHING = 0.01
WORDS_REMEMBERED = 800_000
LONGEST_REMEMBERED = 64  # characters
LINEAR = 30  # characters; the sums of longer words are kept as logarithms, as they would vanish

_LATIN = re.compile("[a-zªµºß-öø-ÿ]+")  # the lower-case letters up to U+00FF
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def vocabulary_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, with the mark of a word's beginning if they have it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    bare = ((p, p.removeprefix("▁")) for p in pieces)
    return sorted({p for p, b in bare if p == "▁" or (b and b == b.lower() and all(unicodedata.category(c)[0] in "LM" for c in b))})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return _LATIN.findall(text)


def beginnings(pieces: list[str]) -> dict[str, int]:
    """Number of each piece, and -1 for a beginning of a piece that is none itself."""
    out = {p[:k]: -1 for p in pieces for k in range(1, len(p))}
    out.update((p, k) for k, p in enumerate(pieces))
    return out


def _lattice(part: str, known: dict[str, int]) -> list[list[tuple[int, int]]]:
    """For each end, the (start, piece) that can end there; piece -1 is a character in no piece."""
    n = len(part)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for start in range(n):
        piece = known.get(part[start], -1)
        out[start + 1].append((start, piece))
        for end in range(start + 2, n + 1):
            piece = known.get(part[start:end])
            if piece is None:
                break  # no piece begins like this
            if piece >= 0:
                out[end].append((start, piece))
    return out


def _log_sum(terms: list[float]) -> float:
    top = max(terms, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


def log_probability(word: str, known: dict[str, int], tables: list[list[float]]) -> list[float]:
    """Log of the word's summed probability in each language.

    Each of ``tables`` has the probability of each piece and, last, that of an
    unknown character.
    """
    lattice = _lattice("▁" + word, known)[1:]
    total = []
    for table in tables:
        if len(word) < LINEAR:
            forward = [1.0]
            for ends in lattice:
                here = 0.0
                for start, piece in ends:
                    here += forward[start] * table[piece]
                forward.append(here)
            total.append(math.log(forward[-1]))
        else:
            logs = [0.0]
            for ends in lattice:
                logs.append(_log_sum([logs[start] + math.log(table[piece]) for start, piece in ends]))
            total.append(logs[-1])
    return total


def expected_counts(counts: dict[str, int], known: dict[str, int], probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the counted words."""
    out, table, logs = np.zeros(len(probability)), probability.tolist(), np.log(probability).tolist()
    for word, n in counts.items():
        part = "▁" + word
        lattice = _lattice(part, known)
        if len(word) < LINEAR:
            forward, backward = [1.0] + [0.0] * len(part), [0.0] * len(part) + [1.0]
            for end in range(1, len(part) + 1):
                forward[end] = sum(forward[start] * table[piece] for start, piece in lattice[end])
            for end in range(len(part), 0, -1):
                for start, piece in lattice[end]:
                    used = table[piece] * backward[end]
                    backward[start] += used
                    out[piece] += n * forward[start] * used / forward[-1]
            continue
        ahead: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
        for end, starts in enumerate(lattice):
            for start, piece in starts:
                ahead[start].append((end, piece))
        before, after = [0.0], [0.0] * (len(part) + 1)
        for ends in lattice[1:]:
            before.append(_log_sum([before[start] + logs[piece] for start, piece in ends]))
        for start in range(len(part) - 1, -1, -1):
            after[start] = _log_sum([logs[piece] + after[end] for end, piece in ahead[start]])
            for end, piece in ahead[start]:
                out[piece] += n * math.exp(before[start] + logs[piece] + after[end] - before[-1])
    return out


def first_probability(pieces: int) -> np.ndarray:
    return np.append(np.full(pieces, 1 / pieces), UNKNOWN)


def next_probability(used: np.ndarray) -> np.ndarray:
    """Probabilities from expected uses; the last entry is that of an unknown character."""
    counted = used[:-1] + SMOOTHING
    return np.append(counted / counted.sum(), UNKNOWN)


def fit(counts: DataFrame, pieces: list[str]) -> tuple[list[str], dict[str, int], list[list[float]]]:
    """Languages, piece numbers and each language's piece probabilities, from a stored table of lang, word and n."""
    spark, known = counts.sparkSession, beginnings(pieces)
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    tables = {language: first_probability(len(pieces)) for language in languages}
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((known, tables))  # bounded by the vocabulary and the number of languages

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, tables = sent.value
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                mine: dict[str, dict[str, int]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    mine.setdefault(lang, {})[word] = n
                for lang, found in mine.items():
                    totals[lang] = totals.get(lang, 0.0) + expected_counts(found, known, tables[lang])
            for lang, used in totals.items():
                at = np.flatnonzero(used[:-1])
                columns = [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(used[at])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "piece", "used"])

        used = {language: np.zeros(len(pieces) + 1) for language in languages}
        parts = counts.mapInArrow(expect, "lang string, piece int, used double")
        # Added up in a fixed order, so that a model does not depend on the order of tasks.
        sums = parts.groupBy("lang", "piece").agg(F.array_sort(F.collect_list("used")).alias("parts"))
        for row in sums.select("lang", "piece", F.aggregate("parts", F.lit(0.0), lambda a, b: a + b).alias("used")).collect():
            used[row["lang"]][row["piece"]] = row["used"]
        tables = {language: next_probability(used[language]) for language in languages}
    return languages, known, [tables[language].tolist() for language in languages]


def train(docs: DataFrame, usable: Column, vocabulary: str, lang_col: str = "lang", text_col: str = "text"):
    """Fit on ``DOCUMENTS`` different texts of each language at most, those of the smallest hashes."""
    rows = docs.filter(usable).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter("lang is not null and text is not null").withColumn("digest", F.xxhash64("text"))
    different = rows.select("lang", "digest").distinct()
    # Of uniform hashes the share below ``share`` holds more than DOCUMENTS but for a chance of 1e-50 or so; only these are ranked.
    sizes = different.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * DOCUMENTS + 100) / F.count("*")).alias("share"))
    low = different.join(F.broadcast(sizes), "lang").filter(F.col("digest") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    least = Window.partitionBy("lang").orderBy("digest")
    ranked = low.withColumn("rank", F.row_number().over(least))
    last = ranked.filter(F.col("rank") <= DOCUMENTS).groupBy("lang").agg(F.max("digest").alias("last"))
    chosen = rows.join(F.broadcast(last), "lang").filter("digest <= last")  # one row per language
    sampled = chosen.groupBy("lang", "digest").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter((lang, w) for lang, text in zip(*(c.to_pylist() for c in batch.columns)) for w in words(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    totals = sampled.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(totals.repartition(partitions_of(docs.sparkSession), "lang", "word"), "language-words")
    return fit(counts, vocabulary_pieces(vocabulary))


def predict(spark: SparkSession, docs: DataFrame, model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score (the language's posterior probability with equal priors)."""
    languages = model[0]
    sent = spark.sparkContext.broadcast(model)  # bounded by the vocabulary and the number of languages
    name = f"word-languages:{zlib.crc32(np.array(model[2]).tobytes())}"

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, known, tables = sent.value

        def logs(word: str) -> bytes:
            return array("d", log_probability(word, known, tables)).tobytes()

        memo = worker_state(name, lambda: Memo(logs, WORDS_REMEMBERED))
        for batch in batches:
            best, scores = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = words(text) if languages else []
                if not found:
                    best.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(len(languages))
                for at in range(0, len(found), 4096):
                    logs_of = b"".join([memo[w] if len(w) <= LONGEST_REMEMBERED else logs(w) for w in found[at : at + 4096]])
                    total += np.frombuffer(logs_of).reshape(-1, len(languages)).sum(axis=0)
                k = int(total.argmax())
                best.append(languages[k])
                scores.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(best, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"]
            )

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(classify, f"{kinds}, lang_pred string, score double")
