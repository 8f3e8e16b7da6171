"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into the other. With
L the longer length that holds exactly if their common prefix and common suffix add up to L - 1 or
more, so at least one of the two reaches L // 2. For L equal to its length and to its length plus
one, every word therefore joins one group by its first L // 2 code points and, read backwards, one
by its last. Groups are sorted next to each other and cut into blocks of bounded size: small groups
share a block, a large group becomes several. A tile compares all words of one block with all of
another (or with themselves) column by column on padded matrices of code points; only blocks
of the same group meet. A pair whose prefix and suffix both reach L // 2 counts where the prefixes
meet. A tile hands on one row per word: how many near words, and the best of them.

The number of comparisons grows with the square of a group of *distinct* words that share a length
and a beginning, not with the corpus; tiles of a large group are spread over all tasks, each holds
two blocks, and no pair is written out.

Words are counted in Python workers, which add up a bounded number of words before Spark sums them.
A word's *form* is its near word of largest count (ties: smallest), if that count is at least ``ratio``
times its own; its *root* is where following forms ends. Counts grow by ``ratio`` each step, so a
chain has at most log(2^63) steps to that base and pointer doubling ends.

Defined cases: a null or empty text has no words; with a null id no code point is deleted (its hash is
undefined); rows that repeat count again; an empty table or vocabulary gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rebuy.llm.common import partitions_of
from rebuy.session import materialize

BLOCK = 512  # words in a block
BLOCK_CHARS = 1 << 16  # code points in a block of very long words
HELD = 400_000  # words a worker adds up before it hands them on
STRETCH = 1 << 20  # code points of a text that are split at once
# A-Z lower-cased; a-z and U+00C0 to U+00FF as they are; everything else ends a word.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def stretches(text: str) -> Iterator[bytes]:
    """The text in Latin-1 with words between spaces, in parts that end between words."""
    data = text.encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while len(data) - at > STRETCH:
        end = data.find(b" ", at + STRETCH)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def damaged(word: bytes, start: int, modulus: int) -> bytes:
    """The word without one code point if ``modulus`` divides the crc32 of id and word; ``start`` is that of the id."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % modulus:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, modulus: int | None = None) -> DataFrame:
    """Words of at least ``min_length`` code points and how often they occur.

    With a ``modulus``, words whose crc32 with their document's id it divides lose one code point first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = None if doc_id is None or modulus is None else zlib.crc32(f"{doc_id}:".encode())
                for part in stretches(text or ""):
                    found = Counter(part.split())
                    if start is None:
                        held.update({w: n for w, n in found.items() if len(w) >= min_length})
                    else:
                        for word, n in found.items():
                            if len(word) >= min_length and len(word := damaged(word, start, modulus)) >= min_length:
                                held[word] += n
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(words: DataFrame) -> DataFrame:
    """Blocks of words: side (0: from the front, 1: read backwards), longest, group (null if several), block, words, counts."""
    length = F.length("word")
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), (length + more).alias("longest"), read.alias("read"))
            for side, read in ((0, F.col("word")), (1, F.reverse("word")))
            for more in (0, 1)
        ]
    )
    rows = words.select("n", F.explode(sides).alias("s")).select("s.side", "s.longest", "s.read", "n")
    rows = rows.withColumn("head", F.expr("substring(read, 1, longest div 2)"))
    key = ["longest", "side", "head", "read"]
    rows = rows.repartitionByRange(partitions_of(words.sparkSession), *key).sortWithinPartitions(*key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out = TaskContext.get().partitionId() << 32, 0, []

        def block(group: str | None, rows: list[tuple]) -> None:
            nonlocal made
            # Larger counts first, then code-point order of the words as written: the first near word is the best.
            order = sorted((-n, read[:: 1 - 2 * side], read) for side, _, read, n, _ in rows)
            out.append((rows[0][0], rows[0][1], group, part + made, [r for _, _, r in order], [-n for n, _, _ in order]))
            made += 1

        def finished() -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["side", "longest", "group", "block", "words", "counts"])
            out.clear()
            return batch

        # ``group``: rows of the group being read; ``whole``: rows of small groups that wait for company.
        group, whole, name, sliced, first = [], [], None, False, True

        def end_of_group(last: bool) -> None:
            nonlocal group, whole, sliced, first
            if group:
                if sliced or first or last:  # may go on in another block or partition
                    block(name[2], group)
                else:
                    if whole and (whole[0][:2] != group[0][:2] or len(whole) + len(group) > limit(group[0][1])):
                        block(None, whole)
                        whole = []
                    whole += group
                first = False
            group, sliced = [], False

        def limit(longest: int) -> int:
            return max(1, min(BLOCK, BLOCK_CHARS // longest))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (row[0], row[1], row[4]) != name:
                    end_of_group(False)
                    name = (row[0], row[1], row[4])
                group.append(row)
                if len(group) >= limit(row[1]):
                    block(name[2], group)
                    group, sliced = [], True
            if out:
                yield finished()
        end_of_group(True)
        if whole:
            block(None, whole)
        if out:
            yield finished()

    schema = "side int, longest int, group string, block long, words array<string>, counts array<long>"
    return rows.select("side", "longest", "read", "n", "head").mapInArrow(cut, schema)


def _matrices(words: list[str], longest: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points by column from the front and from the end, and the lengths."""
    lengths = np.array([len(w) for w in words])
    rows = len(words)
    flat = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    inside = np.arange(longest)[None, :] < lengths[:, None]
    front = np.full((rows, longest), pad, dtype=np.uint8)
    front[inside] = flat
    back = np.full((rows, longest), pad, dtype=np.uint8)
    back[inside[:, ::-1]] = flat
    return np.ascontiguousarray(front.T), np.ascontiguousarray(back[:, ::-1].T), lengths


def _run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common run of columns, for every pair of rows."""
    same = np.ones((a.shape[1], b.shape[1]), dtype=bool)
    total = np.zeros(same.shape, dtype=np.uint8 if len(a) < 256 else np.int64)
    for left, right in zip(a, b):
        same &= left[:, None] == right[None, :]
        if not same.any():
            break
        total += same
    return total


def near_tile(side: int, longest: int, left: list[str], right: list[str]) -> np.ndarray:
    """Which words of ``left`` are near which of ``right``, as far as this side and longer length count them.

    The words are given as the side reads them.
    """
    a_front, a_back, a_len = _matrices(left, longest, 0)
    b_front, b_back, b_len = _matrices(right, longest, 1)
    head = _run(a_front, b_front)
    near = (head >= longest // 2) & (np.maximum(a_len[:, None], b_len[None, :]) == longest)
    if near.any():
        tail = _run(a_back, b_back)
        near &= head.astype(np.int64) + tail >= longest - 1
        near &= (head < longest) | (a_len[:, None] != b_len[None, :])
        if side:
            near &= tail < longest // 2
    return near


NEAR = "word string, n_near long, best_n long, best string"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            turn = 1 - 2 * row["side"]
            left, right = row["words"], row.get("others")
            near = near_tile(row["side"], row["longest"], left, right or left)
            ways = [(near, left, right or left, row["other_counts"] if right else row["counts"])]
            if right:
                ways.append((near.T, right, left, row["counts"]))
            for hit, words, others, counts in ways:
                number, best = hit.sum(axis=1), hit.argmax(axis=1)
                out += [(words[i][::turn], int(number[i]), counts[best[i]], others[best[i]][::turn]) for i in np.flatnonzero(number)]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """For each of the distinct ``words`` (word, n) that has near words: how many, and the best of them with its count."""
    blocks = materialize(_blocks(words), "spelling-blocks")
    parts = partitions_of(words.sparkSession)
    alone = blocks.select("side", "longest", "words", "counts").repartition(4 * parts).mapInArrow(_compare, NEAR)
    key = ["side", "longest", "group"]
    # Names of the blocks of large groups: one row stands for up to BLOCK words.
    slices = blocks.filter("group is not null").select(*key, "block")
    numbered = slices.select(
        *key,
        "block",
        F.row_number().over(Window.partitionBy(*key).orderBy("block")).alias("place"),
        F.count("*").over(Window.partitionBy(*key)).alias("of"),
    )
    numbered = numbered.filter("of > 1")
    bodies = materialize(numbered.join(blocks.select("block", "words", "counts"), "block"), "spelling-slices")
    tiles = bodies.filter("place < of").withColumn("other", F.explode(F.sequence(F.col("place") + 1, F.col("of").cast("int"))))
    others = bodies.select(*key, F.col("place").alias("other"), F.col("words").alias("others"), F.col("counts").alias("other_counts"))
    tiles = tiles.join(others, [*key, "other"]).select("side", "longest", "words", "counts", "others", "other_counts")
    found = alone.unionByName(tiles.repartition(4 * parts).mapInArrow(_compare, NEAR))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """Where following forms ends, for every word that has one; pointers double until none goes on."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not roots.join(next_step, "root", "left_semi").limit(1).count():
            return roots
        roots = materialize(roots.join(next_step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")


def variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    modulus: int | None = None,
) -> DataFrame:
    """Every word of ``min_length`` code points and ``min_count`` occurrences: word, form, root, n, n_near, form_n."""
    words = materialize(word_counts(df, id_col, text_col, min_length, modulus).filter(F.col("n") >= min_count), "spelling-words")
    taken = F.col("best_n") >= ratio * F.col("n")
    known = words.join(near_words(words), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best")).alias("form"),
        F.when(taken, F.col("best_n")).alias("form_n"),
    )
    known = materialize(known, "spelling-known")
    found = known.join(_roots(known.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
