"""Quality by a sparse ensemble of rules over text statistics.

Each text is described by statistics that Spark computes with its own functions. Boosted shallow
trees, fitted to a bounded sample of labelled documents, give candidate rules: every path from a
root to a node is a conjunction of comparisons. A logistic regression with an L1 penalty weighs the
rules, and most drop out. The rest is compiled into one Spark column expression, so scoring is a
projection over whole texts, without Python.

``SAMPLE`` bounds the labelled documents that are learned from.

Defined cases: a null or empty text has statistics 0, and gets the score of these. Without labelled
documents of both kinds nothing can be learned: the score is the share of label 1 (0.5 without
labels). Null labels and rows without an id are not learned from; ids that are labelled twice count twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from rebuy.llm.common import bounded_sample
from rebuy.session import materialize

SAMPLE = 12_000
TREES = 12
DEPTH = 3
PENALTY = 0.002

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", value)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are 0 for an empty one."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.filter(F.split(trimmed, " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    sentences = F.filter(F.split(text, r"[.!?\n]+\s*"), lambda s: s != "")
    return {
        "chars": F.length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "lines": F.size(lines).cast("double"),
        "sentences": F.size(sentences).cast("double"),
        "different_words": F.size(F.array_distinct(words)).cast("double"),
        "different_lines": F.size(F.array_distinct(lines)).cast("double"),
        "different_sentences": F.size(F.array_distinct(sentences)).cast("double"),
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"),
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:?'\"()-]")).cast("double"),
        "stops": F.regexp_count(text, F.lit(r"[.,;:?]")).cast("double"),
        "digits": F.regexp_count(text, F.lit(r"[0-9]")).cast("double"),
    }


def ratios() -> dict[str, Column]:
    """The rules' variables, from the columns that ``statistics`` names."""

    def over(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    return {
        "log_words": F.ln(F.col("words") + 1),
        "word_length": over("chars", "words"),
        "sentence_length": over("words", "sentences"),
        "line_length": over("words", "lines"),
        "word_variety": over("different_words", "words"),
        # Variety falls with length in any language; this takes the usual fall out.
        "word_growth": F.when(F.col("words") > 1, F.ln(F.greatest("different_words", F.lit(1.0))) / F.ln("words")).otherwise(F.lit(1.0)),
        "line_variety": over("different_lines", "lines"),
        "sentence_variety": over("different_sentences", "sentences"),
        "capital_share": over("capitals", "chars"),
        "symbol_share": over("symbols", "chars"),
        "stop_rate": over("stops", "words"),
        "digit_share": over("digits", "chars"),
    }


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1 as a column expression over the ratios."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, value in rule:
        out = out & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
    return out


def tree_rules(model, names: list[str]) -> list[Rule]:
    """Conjunctions on all paths from the roots, without repeats; bounds on one statistic are merged."""
    found: dict[Rule, None] = {}

    def walk(node, path: dict[tuple[str, str], float]) -> None:
        if path:
            found[tuple(sorted((n, s, v) for (n, s), v in path.items()))] = None
        if node.numDescendants() == 0:
            return
        name, value = names[node.split().featureIndex()], float(node.split().threshold())
        low, high = path.get((name, "<="), math.inf), path.get((name, ">"), -math.inf)
        walk(node.leftChild(), path | {(name, "<="): min(low, value)})
        walk(node.rightChild(), path | {(name, ">"): max(high, value)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def described(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The kept columns in one struct ``kept`` and all ratios, so that no kept name clashes with a statistic."""
    counts = F.struct(*[c.alias(n) for n, c in statistics(F.col(text_col)).items()])
    counted = docs.select(F.struct(*keep).alias("kept"), counts.alias("counted")).select("kept", "counted.*")
    return counted.select("kept", *[c.alias(n) for n, c in ratios().items()])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality") -> RuleEnsemble:
    """Fit on about ``SAMPLE`` labelled documents at most, chosen by a hash of their ids and texts.

    ``usable`` tells which rows may be learned from.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("double").alias("label")).filter("label in (0, 1)")
    rows = docs.select("doc_id", "text").filter(usable).join(known, F.col("doc_id") == F.col("__id"))
    chosen = bounded_sample(rows, SAMPLE, "doc_id", "text")
    names = list(ratios())
    sample = materialize(described(chosen, "text", [F.col("label")]).select("kept.label", *names), "quality-sample")
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        share = min(max(kinds.get(1.0, 0) / max(1, sum(kinds.values())), 1e-6), 1 - 1e-6) if kinds else 0.5
        return RuleEnsemble(math.log(share / (1 - share)), [])
    vectors = sample.select("label", array_to_vector(F.array(*names)).alias("features")).coalesce(4)
    forest = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=5, seed=9, stepSize=0.3).fit(vectors)
    rules = tree_rules(forest, names)
    if not rules:
        share = kinds[1.0] / sum(kinds.values())
        return RuleEnsemble(math.log(share / (1 - share)), [])
    fired = sample.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features")).coalesce(4)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(fired)
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(float(lasso.intercept), [(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def score(docs: DataFrame, model: RuleEnsemble, text_col: str, keep: list[Column]) -> DataFrame:
    """The kept columns and the score."""
    return described(docs, text_col, keep).select("kept.*", model.score().alias("score"))
