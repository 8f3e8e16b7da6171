"""Small tables with the awkward cases every operator has to take, and brute-force versions."""

from __future__ import annotations

import random
import re

from rebuy.llm.common import words_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_sha256 string, label double, word string"


def docs_table(spark, rows):
    """Documents from (id, text) pairs, with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), "clash", 1.0, "clash") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng: random.Random, n: int) -> str:
    syllables = "ba ce di fo gu ha le mi no pu ra se ti vo".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return re.sub(r"((?:\w+ ){7}\w+) ", r"\1. ", " ".join(words))


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empties, ties, repeated rows, near copies, a very long text, odd characters."""
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(8)]
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, base[0].upper()) for i in range(12)]
    rows += [(40 + i, base[1].replace(" ", " x ", 1 + i % 3)) for i in range(6)]
    rows += [(60, None), (61, ""), (62, None), (None, base[2]), (None, None), (63, "..."), (64, "one two"), (65, "One two!")]
    rows += [(3, base[3]), (3, base[3]), (3, "same id, other text of a few words more")]
    rows += [(70, prose(rng, 9000)), (71, "É́ ﬁ <|endoftext|> it's 12 x\ty\r\n" + "z" * 3000), (72, "ÀB ab İ ß")]
    return rows


def shingles(text: str | None) -> frozenset:
    words = words_of(text)
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
