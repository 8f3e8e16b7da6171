"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens do not. Token labels are derived from a bounded sample of labelled
documents: words and word beginnings that are far more frequent in toxic documents than in others
are ranked by how many toxic documents they explain that no earlier one explains; tokens that they
match in toxic documents are labelled toxic. A two-state linear-chain CRF (toxic or not, features:
the word, its beginnings and its end, the neighbouring words) is fitted to these sentences, so
tokens that are not in the list are tagged by their shape and company. Forward-backward gives each
token's marginal; a document's score is a logistic function of its greatest marginal and of the
expected number of toxic tokens, fitted to the document labels. Tokens with a marginal of 0.5 or
more are the offending spans.

Parameters that bound the fit: ``SAMPLE`` documents of each label (weighted by how many there are) of
at most ``FIT_CHARS`` code points, ``SENTENCES`` sentences in pieces of at most ``FIT_TOKENS`` tokens.
Scoring reads every text and every sentence whole.

Defined cases: a text without words (null, empty) has no tokens; its score is that of a document
with no toxic token. Without labelled documents of both kinds nothing can be learned: scores are
then the share of toxic labels (0 without labels). Labels that are null, and rows without an id,
are not learned from; ids that are labelled twice count twice.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebuy.llm.common import Memo, bounded_sample, worker_state

SAMPLE = 1500  # labelled documents of each label
FIT_CHARS = 20_000  # code points of a document of the sample; longer ones are scored, not learned from
SENTENCES = 12_000
FIT_TOKENS = 64  # of a sentence of the fit; longer ones are learned from in pieces
LEAST_EXPLAINED = 1.0  # documents that a listed term newly explains, net of clean ones, times 3, that have it
WEIGHTS = 1 << 18
EPOCHS = 60
SIGNALS = 4
TEXTS = 512  # texts scored side by side
TOKENS_REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?\n]+")
_IN_CONTEXT = re.compile("[\u0130\u03a3]")  # lower case is two characters, or depends on the neighbours; else a letter gives a letter
_OWN, _BEGINNING, _BEFORE, _AFTER = map(zlib.crc32, (b"o", b"o^", b"p", b"n"))


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words by sentence; all words of the text, in order."""
    text = text or ""
    if not _IN_CONTEXT.search(text):
        return [words for part in _END.split(text.lower()) if (words := _WORD.findall(part))]
    parts = ([w.lower() for w in _WORD.findall(part)] for part in _END.split(text))
    return [words for words in parts if words]


def _beginnings(word: str) -> list[str]:
    return [f"^{word[:n]}" for n in range(3, 9) if len(word) > n]


def _slot(kind: int, value: str) -> int:
    """``kind`` is the checksum of what comes before the value."""
    return zlib.crc32(value.encode(), kind) % WEIGHTS


def own_slots(word: str) -> list[int]:
    """Of the word, its beginnings, its end, and of any word."""
    crc = zlib.crc32
    out = [crc(word.encode(), _OWN) % WEIGHTS]
    for n in range(3, min(9, len(word))):
        out.append(crc(word[:n].encode(), _BEGINNING) % WEIGHTS)
    out += _slot(_OWN, f"{word[-3:]}$"), _slot(_OWN, "any")
    return out


def offending_terms(documents: list[tuple[set[str], int]], weight: tuple[float, float]) -> list[str]:
    """Words and beginnings that explain the toxic documents, most useful first (greedy cover).

    ``documents`` are sets of words with their labels; ``weight`` is what a
    document of label 0 and of label 1 stands for. A word that a chosen term
    matches is explained, so longer and shorter beginnings of it gain nothing.
    """
    toxic = sum(label for _, label in documents)
    count: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for words, label in documents:
        for term in words | {b for w in words for b in _beginnings(w)}:
            count[term][label] += 1
    base, strong = toxic / len(documents), set()
    for term, (c, t) in count.items():
        rate = t / (c + t)
        if t >= 3 and rate > base and weight[1] * t >= 0.75 * (weight[0] * c + weight[1] * t):
            surprise = t * math.log(rate / base) + (c * math.log((1 - rate) / (1 - base)) if c else 0)
            if surprise >= 7.5:
                strong.add(term)
    where: dict[str, set[tuple[int, str]]] = defaultdict(set)
    for k, (words, label) in enumerate(documents):
        if label:
            for word in words:
                for term in strong.intersection([word, *_beginnings(word)]):
                    where[term].add((k, word))
    out, covered = [], Counter()
    while where:
        # A further word of a document counts less than its first.
        worth = {
            term: sum(1 / (1 + covered[k]) ** 2 for k in {k for k, _ in pairs}) - 3 * count[term][0] for term, pairs in where.items()
        }
        best = max(worth, key=lambda term: (worth[term], term))
        if worth[best] < LEAST_EXPLAINED:
            break
        out.append(best)
        explained = where.pop(best)
        covered.update({k for k, _ in explained})
        for term in list(where):
            where[term] -= explained
            if not where[term]:
                del where[term]
    return out


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WEIGHTS, np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    head: np.ndarray = field(default_factory=lambda: np.zeros(SIGNALS))  # of the document score

    def parts(self) -> "Memo":
        """For a word, what it adds to its own toxic potential, to the next word's, and to the one before: three packed doubles."""
        weight, pack = self.weights.tolist(), struct.Struct("3d").pack

        def of(word: str) -> bytes:
            own = sum([weight[k] for k in own_slots(word)])
            return pack(own, weight[_slot(_BEFORE, word)], weight[_slot(_AFTER, word)])

        return Memo(of, TOKENS_REMEMBERED)


def marginals(potential: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: float) -> np.ndarray:
    """P(token is toxic) for sentences in rows, by forward-backward on odds.

    ``potential`` is the toxic state's potential against the other's;
    positions beyond a sentence's length give 0.
    """
    n, width = potential.shape
    move = np.exp(transitions)
    lift = np.exp(np.clip(potential, -30, 30))
    forward = np.zeros((n, width))
    odds = np.full(n, math.exp(start))
    for t in range(width):
        if t:
            odds = (move[0, 1] + move[1, 1] * odds) / (move[0, 0] + move[1, 0] * odds)
        odds = np.minimum(odds * lift[:, t], 1e30)
        forward[:, t] = odds
    back = np.ones((n, width))
    for t in range(width - 2, -1, -1):
        ahead = lift[:, t + 1] * back[:, t + 1]
        ratio = (move[1, 0] + move[1, 1] * ahead) / (move[0, 0] + move[0, 1] * ahead)
        back[:, t] = np.where(t + 1 < lengths, ratio, 1.0)
    both = forward * back
    out = both / (1 + both)
    out[np.arange(width)[None, :] >= lengths[:, None]] = 0
    return out


def _pair_marginals(potential: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: float) -> np.ndarray:
    """Expected transitions (2 x 2), summed over all sentences; log-space forward-backward."""
    n, width = potential.shape
    alpha = np.zeros((n, width, 2))
    emit = np.stack([np.zeros_like(potential), potential], axis=2)
    alpha[:, 0] = emit[:, 0] + np.array([0.0, start])
    for t in range(1, width):
        alpha[:, t] = np.logaddexp(alpha[:, t - 1, 0:1] + transitions[0], alpha[:, t - 1, 1:2] + transitions[1]) + emit[:, t]
    beta = np.zeros((n, width, 2))
    for t in range(width - 2, -1, -1):
        ahead = emit[:, t + 1] + beta[:, t + 1]
        new = np.stack([np.logaddexp(transitions[s, 0] + ahead[:, 0], transitions[s, 1] + ahead[:, 1]) for s in (0, 1)], axis=1)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], new, 0.0)
    total = np.logaddexp(alpha[:, 0, 0] + beta[:, 0, 0], alpha[:, 0, 1] + beta[:, 0, 1])
    out = np.zeros((2, 2))
    for t in range(width - 1):
        inside = t + 1 < lengths
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(alpha[:, t, a] + transitions[a, b] + emit[:, t + 1, b] + beta[:, t + 1, b] - total)
                out[a, b] += p[inside].sum()
    return out


def fit_chain(tagged: list[list[tuple[str, int]]], model: Model) -> None:
    """Penalised maximum likelihood of labelled token sequences, by Adam on whole batches."""
    tagged = sorted(tagged, key=len)
    slots, owner, labels, lengths = [], [], [], np.array([len(s) for s in tagged])
    position, count = [], 0
    for row, sentence in enumerate(tagged):
        for t, (word, label) in enumerate(sentence):
            mine = own_slots(word)
            if t:
                mine.append(_slot(_BEFORE, sentence[t - 1][0]))
            if t + 1 < len(sentence):
                mine.append(_slot(_AFTER, sentence[t + 1][0]))
            slots += mine
            owner += [count] * len(mine)
            position.append((row, t))
            labels.append(label)
            count += 1
    slots, owner, labels = np.array(slots), np.array(owner), np.array(labels, float)
    rows, places = np.array(position).T
    used, slots = np.unique(slots, return_inverse=True)
    truth = np.zeros((2, 2))
    for sentence in tagged:
        for (_, a), (_, b) in zip(sentence, sentence[1:]):
            truth[a, b] += 1
    weights, transitions, start = np.zeros(len(used)), np.zeros((2, 2)), 0.0
    first_truth = sum(s[0][1] for s in tagged)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, transitions, np.zeros(1))]
    cuts = np.searchsorted(lengths, [8, 16, 32]).tolist()
    groups = [(a, b) for a, b in zip([0, *cuts], [*cuts, len(tagged)]) if b > a]
    for epoch in range(1, EPOCHS + 1):
        token = np.bincount(owner, weights[slots], minlength=count)
        expected, pairs, first = np.zeros(count), np.zeros((2, 2)), 0.0
        for a, b in groups:
            inside = (rows >= a) & (rows < b)
            matrix = np.zeros((b - a, lengths[b - 1]))
            matrix[rows[inside] - a, places[inside]] = token[inside]
            p = marginals(matrix, lengths[a:b], transitions, start)
            expected[inside] = p[rows[inside] - a, places[inside]]
            first += p[:, 0].sum()
            pairs += _pair_marginals(matrix, lengths[a:b], transitions, start)
        slopes = (
            np.bincount(slots, (labels - expected)[owner], minlength=len(used)) - 0.05 * weights,
            truth - pairs - 0.5 * transitions,
            np.array([first_truth - first - 0.5 * start]),
        )
        for k, (slope, (m, v)) in enumerate(zip(slopes, moments)):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            change = 0.25 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
            if k == 0:
                weights = weights + change
            elif k == 1:
                transitions = transitions + change
            else:
                start += float(change[0])
    model.weights[used] = weights
    model.transitions, model.start = transitions, start


def _signals(probabilities: list[np.ndarray]) -> np.ndarray:
    """What the document score looks at: 1, the greatest marginal's log-odds, the logs of the toxic tokens' expected number and share."""
    p = np.concatenate(probabilities) if probabilities else np.zeros(1)
    top = min(max(float(p.max()), 1e-4), 1 - 1e-4)
    return np.array([1.0, math.log(top / (1 - top)), math.log1p(float(p.sum())), math.log(float(p.sum()) / (len(p) + 20) + 1e-4)])


def token_marginals(split: list[list[list[str]]], model: Model, memo: Memo) -> list[list[np.ndarray]]:
    """The tokens' marginals by text and sentence; sentences of all texts are worked on side by side."""
    flat = [s for text in split for s in text]
    out: list[np.ndarray] = [np.zeros(0)] * len(flat)
    lengths = np.array([len(s) for s in flat], np.int64)
    order = np.argsort(lengths, kind="stable")
    if len(flat):
        tokens = map(memo.__getitem__, chain.from_iterable(flat[k] for k in order))
        parts = np.frombuffer(b"".join(tokens)).reshape(-1, 3)
        bounds = np.append(0, np.cumsum(lengths[order]))
        potential = parts[:, 0].copy()
        potential[1:] += parts[:-1, 1]
        potential[:-1] += parts[1:, 2]
        # Neighbours do not reach across sentences.
        firsts = bounds[1:-1]
        potential[firsts] -= parts[firsts - 1, 1]
        potential[firsts - 1] -= parts[firsts, 2]
        ordered, at = lengths[order], 0
        while at < len(order):
            # As many sentences as are not much longer than the first, so little is padded.
            end = min(int(np.searchsorted(ordered, ordered[at] * 1.25 + 1, side="right")), at + 20_000)
            group = ordered[at:end]
            inside = np.arange(int(group[-1]))[None, :] < group[:, None]
            matrix = np.zeros(inside.shape)
            matrix[inside] = potential[bounds[at] : bounds[end]]
            found = marginals(matrix, group, model.transitions, model.start)
            for k, (row, length) in enumerate(zip(order[at:end].tolist(), group.tolist())):
                out[row] = found[k, :length]
            at = end
    at, result = 0, []
    for text in split:
        result.append(out[at : at + len(text)])
        at += len(text)
    return result


def fit(sample: list[tuple[str | None, int]], totals: tuple[int, int] | None = None) -> Model:
    """The model of a bounded list of (text, toxic) documents; ``totals`` counts the labels it was drawn from."""
    model = Model()
    toxic = sum(label for _, label in sample)
    totals = totals or (len(sample) - toxic, toxic)
    if not toxic or toxic == len(sample):
        share = totals[1] / max(1, sum(totals))
        model.head[0] = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return model
    weight = totals[0] / (len(sample) - toxic), totals[1] / toxic
    split = [sentences(text) for text, _ in sample]
    found = [({w for s in text for w in s}, label) for text, (_, label) in zip(split, sample)]
    listed = set(offending_terms(found, weight))

    def matches(word: str) -> bool:
        return word in listed or any(b in listed for b in _beginnings(word))

    with_toxic, without = [], []
    for text, (_, label) in zip(split, sample):
        for sentence in text:
            for at in range(0, len(sentence), FIT_TOKENS):
                tagged = [(w, int(bool(label) and matches(w))) for w in sentence[at : at + FIT_TOKENS]]
                (with_toxic if any(t for _, t in tagged) else without).append(tagged)
    pick = np.random.default_rng(3)
    for group in (with_toxic, without):
        pick.shuffle(group)
    half = SENTENCES // 2
    fit_chain([*with_toxic[:half], *without[:half]], model)

    memo, x = model.parts(), []
    for at in range(0, len(split), TEXTS):
        x += [_signals(p) for p in token_marginals(split[at : at + TEXTS], model, memo)]
    x = np.array(x)
    y = np.array([label for _, label in sample], float)
    w = np.where(y == 1, weight[1], weight[0])
    w *= len(w) / w.sum()
    head = np.zeros(SIGNALS)
    for _ in range(30):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        slope = x.T @ (w * (y - p)) - 0.1 * head
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(SIGNALS)
        head = head + np.linalg.solve(bend, slope)
    model.head = head
    return model


def _spans(text: str | None, found: list[np.ndarray]) -> list[dict]:
    if not any((p >= 0.5).any() for p in found):
        return []
    # Splitting at sentence ends drops no word, so words come in the same order.
    pairs = zip(_WORD.finditer(text), chain.from_iterable(found))
    return [{"start": m.start(), "end": m.end(), "probability": float(p)} for m, p in pairs if p >= 0.5]


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic") -> Model:
    """Fit on at most ``SAMPLE`` documents of each label (about), chosen by a hash of their ids and texts.

    ``usable`` tells which rows may be learned from.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    rows = docs.select("doc_id", "text").filter(usable).join(known, F.col("doc_id") == F.col("__id"))
    chosen, totals = [], []
    for label in (0, 1):
        mine = rows.filter(F.col("label") == label)
        totals.append(mine.count())
        short = mine.filter(F.length(F.coalesce("text", F.lit(""))) <= FIT_CHARS)
        picked = bounded_sample(short, SAMPLE, "doc_id", "text").select("text").collect()
        chosen += [(text, label) for text in sorted((r["text"] for r in picked), key=lambda t: t or "")]
    return fit(chosen, (totals[0], totals[1]))


def score(spark: SparkSession, docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, score and, if asked for, the offending spans (start, end, probability; offsets in code points)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # WEIGHTS numbers, whatever the data; plain arrays, as workers need no copy of this package.
    sent = spark.sparkContext.broadcast((model.weights, model.transitions, model.start, model.head))
    name = f"toxic-tokens:{zlib.crc32(model.weights.tobytes())}"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        memo = worker_state(name, model.parts)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts, scores, spans = part.column(1).to_pylist(), [], []
                for text, found in zip(texts, token_marginals([sentences(t) for t in texts], model, memo)):
                    z = float(_signals(found) @ model.head)
                    scores.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
                    if with_spans:
                        spans.append(_spans(text, found))
                columns = [part.column(0), pa.array(scores, pa.float64())]
                names = ["doc_id", "score"]
                if with_spans:
                    columns.append(pa.array(spans, pa.list_(span)))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, score double" + ", spans array<struct<start: int, end: int, probability: double>>" * with_spans
    return docs.select("doc_id", "text").mapInArrow(tag, schema)
