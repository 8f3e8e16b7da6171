"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a selector in its upper four bits and a number of equally wide ids in the
other sixty; the selector tells how many. Each word takes as many of the next ids as fit. Ids are
coded in blocks of 128 that start a new word, and the first word of every block is listed, so
blocks are coded and decoded side by side with array operations. A value of more than 60 bits is
an escape: selector 0 and the value's place in the page's list of escapes.

A *page* is one row of a Parquet table and holds whole documents, at least ``PAGE_IDS`` ids unless
it is the last of its part; parts follow each other in ascending document order. Spark's own writer
commits the pages, so any store that Spark writes to will do, and a lost task leaves nothing behind.

Defined cases: a null or empty text gives just the end id. Rows with a null id come first; rows that repeat
an id are ordered by a hash of the text. An empty table gives an empty table of pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rebuy.llm.common import partitions_of
from rebuy.llm.tokens import encoder

# Selectors 1 to 14: ids in a word and bits of each id.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
BLOCK = 128
PAD = 60
PAGE_IDS = 1 << 19
# Bits of each number below 1 << 16, as ids of most vocabularies are.
SMALL = np.repeat(np.arange(17), [1, *(1 << np.arange(16))]).astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < len(SMALL):
        return SMALL[values]
    width = np.zeros(values.shape, dtype=np.uint8)
    for bits in np.unique(BITS):
        width[values >= np.uint64(1) << np.uint64(bits)] = bits + 1
    return width


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and the escapes."""
    values = np.asarray(values, dtype=np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    row = BLOCK + PAD
    padded = np.zeros((blocks, row), dtype=np.uint64)
    body = np.zeros(blocks * BLOCK, dtype=np.uint64)
    body[: len(values)] = values
    padded[:, :BLOCK] = body.reshape(blocks, BLOCK)
    flat = padded.ravel()
    widths = np.append(_widths(flat), np.zeros(PAD, np.uint8))
    n = len(flat)
    # Largest width in the next 1, 2, 4, ... ids; any other stretch is covered by two of these.
    runs = {1: widths}
    for size in (2, 4, 8, 16, 32):
        half = runs[size // 2]
        runs[size] = np.maximum(half[: len(half) - size // 2], half[size // 2 :])
    fitting = np.zeros(n, dtype=np.uint8)  # what takes fewer and wider ids fits as well
    for selector in range(14, 0, -1):
        count = int(COUNTS[selector])
        size = 1 << (count.bit_length() - 1)
        run = runs[size]
        widest = run[:n] if size == count else np.maximum(run[:n], run[count - size : count - size + n])
        fitting += widest <= BITS[selector]
    best = np.where(fitting, np.uint8(15) - fitting, np.uint8(0))  # an escape unless something fits
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, len(values)) - np.arange(blocks) * BLOCK + np.arange(blocks) * row
    at, chosen = np.arange(blocks) * row, np.zeros(n, dtype=bool)
    jump = COUNTS[best]
    while len(at):
        chosen[at] = True
        at = at + jump[at]
        active = at < ends
        at, ends = at[active], ends[active]
    starts = np.flatnonzero(chosen)
    selectors = best[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        if selector == 0:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        for j in range(COUNTS[selector]):
            words[mine] |= flat[starts[mine] + j] << np.uint64(j * BITS[selector])
    firsts = np.searchsorted(starts, np.arange(blocks) * row).astype(np.uint32)
    return words, firsts, flat[starts[selectors == 0]]


def decode(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts.astype(np.int64), len(words))))
    place = before - before[firsts.astype(np.int64)][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    for selector in np.unique(selectors):
        mine = selectors == selector
        word, at, end = words[mine], place[mine], limit[mine]
        if selector == 0:
            out[at] = escapes[(word & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[selector])) - 1)
        for j in range(COUNTS[selector]):
            inside = at + j < end
            out[at[inside] + j] = (word[inside] >> np.uint64(j * BITS[selector])) & mask
    return out


def write_token_files(
    df: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text, add ``end_id``, and write the ids in ascending id order."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(partitions_of(df.sparkSession), F.col("doc_id").asc_nulls_first(), tie)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, part, end = encoder(vocabulary).texts, TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        names = ["part", "page", "first", "n_ids", "doc_ids", "ends", "words", "firsts", "escapes"]
        state = {"page": 0, "first": 0}

        def page(ids: list, texts: list[bytes], id_arrow: pa.DataType) -> pa.RecordBatch:
            values = np.frombuffer(b"".join(texts), dtype="<u4")
            words, firsts, escapes = encode(values)
            ends = np.cumsum([len(t) // 4 for t in texts])
            row = [
                pa.array([part], pa.int32()),
                pa.array([state["page"]], pa.int32()),
                pa.array([state["first"]], pa.int64()),
                pa.array([len(values)], pa.int64()),
                pa.array([ids], pa.list_(id_arrow)),
                pa.array([ends.tolist()], pa.list_(pa.int64())),
                *(pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((words, "<u8"), (firsts, "<u4"), (escapes, "<u8"))),
            ]
            state["page"] += 1
            state["first"] += len(values)
            return pa.RecordBatch.from_arrays(row, names)

        ids, texts, held, id_arrow = [], [], 0, None
        for batch in batches:
            id_arrow = batch.column(0).type
            for doc_id, data in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1))):
                ids.append(doc_id)
                texts.append(data + end)
                held += len(texts[-1]) // 4
                if held >= PAGE_IDS:
                    yield page(ids, texts, id_arrow)
                    ids, texts, held = [], [], 0
        if texts:
            yield page(ids, texts, id_arrow)

    schema = (
        f"part int, page int, first long, n_ids long, doc_ids array<{id_type}>, ends array<long>, "
        "words binary, firsts binary, escapes binary"
    )
    ordered.mapInArrow(pages, schema).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents decoded from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc_id", "place", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                words, firsts, escapes = (np.frombuffer(row[c].as_py(), t) for c, t in (("words", "<u8"), ("firsts", "<u4"), ("escapes", "<u8")))
                ids = decode(words, firsts, escapes, row["n_ids"].as_py()).astype("<u4")
                ends = np.array(row["ends"].values, dtype=np.int64)
                starts = np.append(0, ends[:-1])
                data = memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                columns = [
                    pa.array(np.full(len(ends), row["part"].as_py()), pa.int32()),
                    row["doc_ids"].values,
                    pa.array(starts + row["first"].as_py(), pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, doc_id {id_type}, place long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = files.mapInArrow(documents, schema)
    # One row per part; their number is that of the shuffle partitions at writing.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select(
        "part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before")
    )
    columns = ["doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return found.join(F.broadcast(before), "part").select(*columns)
