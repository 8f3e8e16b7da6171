"""Benchmark decontamination by a prefix-filtered join on words.

Benchmark items are cut into windows of ``window`` words (an item of fewer words is one window).
To contain a window a document must contain each of its words, so it suffices to look at one: the
window's rarest word in the corpus, its *prefix token*. Documents list where prefix tokens occur,
with the words around; these lists are joined with the windows on the token, the window's length
and the token's place in it bound what can match, and the words are then compared one by one.

Two passes over the documents: one counts how many of them have each benchmark word, the other
lists occurrences. Both skip other words by a bitmap of fixed size, whatever the benchmark's size;
a word that only shares a bit with a benchmark word is dropped by the join. Windows and
occurrences meet in a shuffle join, which Spark may split where a token is frequent.

Defined cases: null, empty and word-less texts have no words: 0 hits, not contaminated; such items
match nothing. Item ids are compared as strings; items with a null id count as one item named
"null". Rows that repeat an id are separate documents. Equal windows of several items are joined
once. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebuy.llm.common import words_of
from rebuy.session import materialize

WINDOW = 13
BITMAP_BITS = 1 << 23  # 1 MB, sent to every task


def _item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[w.decode("utf-8") for w in words_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["item_id", "words"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(split, "item_id string, words array<string>").filter("size(words) > 0")


def item_windows(words: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item and distinct window: item_id, words."""
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("words"), i + 1, F.lit(window)))
    return words.select("item_id", F.explode(F.array_distinct(cut)).alias("words"))


def _bitmap(words: DataFrame, column: str) -> bytes:
    """A set of words as ``BITMAP_BITS`` bits; at most BITMAP_BITS / 64 rows reach the driver."""
    at = F.pmod(F.crc32(F.encode(column, "UTF-8")), F.lit(BITMAP_BITS))
    bits = words.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(pmod(at, 64) AS INT))")).alias("bits")
    )
    cells = np.zeros(BITMAP_BITS // 64, dtype="<i8")
    for row in bits.collect():
        cells[row["cell"]] = row["bits"]
    return cells.tobytes()


def _known(words: list[bytes], bitmap: bytes) -> list[bytes]:
    """The distinct words whose bit is set."""
    crc, mask = zlib.crc32, BITMAP_BITS - 1
    return [w for w in set(words) if bitmap[(at := crc(w) & mask) >> 3] >> (at & 7) & 1]


def document_counts(docs: DataFrame, text_col: str, bitmap: bytes) -> DataFrame:
    """How many documents have each word of the bitmap; counted within tasks first."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_known(words_of(text), bits))
            if len(seen) > 200_000:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    def _counted(seen: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("utf-8") for w in seen], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, bitmap: bytes, window: int) -> DataFrame:
    """Per document its words' number and the places of prefix tokens with up to ``window`` - 1 words on each side."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, side = sent.value, window - 1
        place = pa.struct([("at", pa.int32()), ("left", pa.int32()), ("around", pa.list_(pa.string()))])
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                wanted = set(_known(words, bits))
                here = []
                if wanted:
                    for at, word in enumerate(words):
                        if word in wanted:
                            lo = max(0, at - side)
                            here.append({"at": at, "left": at - lo, "around": [w.decode("utf-8") for w in words[lo : at + side + 1]]})
                found.append(here)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], ["doc_id", "n_words", "places"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        scan, f"doc_id {id_type}, n_words long, places array<struct<at: int, left: int, around: array<string>>>"
    )


def _covered(spans: Column) -> Column:
    """Words inside any of the (start, end) spans; spans come sorted."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["end"], s["end"]).alias("end"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids), spans (hit word ranges)."""
    words = materialize(_item_words(items, item_col, item_text_col), "benchmark-words")
    vocabulary = words.select(F.explode("words").alias("word")).distinct()
    counts = document_counts(docs, text_col, _bitmap(vocabulary, "word"))
    rarity = vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

    windows = item_windows(words, window).withColumn("window_id", F.sha2(F.concat_ws(" ", "words"), 256))
    by_item = windows.select("window_id", "item_id").distinct()
    distinct = windows.dropDuplicates(["window_id"]).select("window_id", "words")
    tokens = distinct.select("window_id", F.posexplode("words").alias("place", "word")).join(rarity, "word")
    rarest = tokens.groupBy("window_id").agg(F.min(F.struct("n", "word", "place")).alias("rare"))
    # A window with a word that no document has cannot occur.
    prefixed = rarest.filter("rare.n > 0").join(distinct, "window_id").select(
        "window_id", F.col("rare.word").alias("token"), F.col("rare.place").alias("place"), F.col("words").alias("window")
    )
    prefixed = materialize(prefixed, "benchmark-windows")

    scanned = _occurrences(docs, id_col, text_col, _bitmap(prefixed, "token"), window)
    stored = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "document-tokens")
    places = stored.select("row", F.explode("places").alias("p")).select(
        "row", "p.at", "p.left", "p.around", F.get("p.around", F.col("p.left")).alias("token")
    )
    begins = F.col("left") - F.col("place")
    matched = places.join(prefixed, "token").filter(
        (begins >= 0)
        & (begins + F.size("window") <= F.size("around"))
        & (F.slice("around", F.greatest(begins, F.lit(0)) + 1, F.size("window")) == F.col("window"))
    )
    start = (F.col("at") - F.col("place")).cast("int")
    hits = matched.select("row", "window_id", F.struct(start.alias("start"), (start + F.size("window")).alias("end")).alias("span"))
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    named = hits.select("row", "window_id").distinct().join(by_item, "window_id").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return (
        stored.select("row", "doc_id", "n_words")
        .join(spans.join(named, "row"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
            F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
        )
    )


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns."""
    found = find_contamination(docs.withColumn("__key", _row_key(docs, id_col, text_col)), items, "__key", text_col)
    bad = found.filter(contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("doc_id").alias("__bad"))
    return docs.withColumn("__key", _row_key(docs, id_col, text_col)).join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Whether a row is contaminated depends on its text alone, so equal keys are no harm."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
