"""Exact ranked lexical search with sparse ball trees.

A document's vector holds, for each term of the queries, an integer weight of its occurrences; a
query's vector holds the term's rarity times its repeats; the score is their inner product, in
whole numbers. Terms of no query add nothing, so documents are kept as short sparse rows.

Documents are laid out by their rarest-looking query term and cut into trees of ``TREE`` rows. Such a
subtree is split by two far-apart rows down to leaves of ``LEAF``. Every node has its centroid and
radii: one of the whole vector, and one for each term. As query weights are not negative, only
deviations upwards count: no row below a node scores more than ``<q, c> + |q| R`` nor more than
``<q, c + r>``; the smaller one is the node's bound. It is rounded up by more than all the rounding in it can
add up to. A query walks a tree from the best bound down, scores leaves exactly in
64-bit integers, and stops when no bound reaches its 20th score; equal scores must still be looked at because
of their order by id. It starts with the 20th best score within a bounded sample of
documents, which no true result lies below, so most trees are left at the root.

Queries are taken in blocks of about ``QUERIES`` rows or ``QUERY_CHARS`` code points; each block is broadcast with its terms and reads the
documents once. Corpus numbers (N, L, document frequencies) cover all documents.

Defined cases: a null text has no terms; such documents and queries are ranked nowhere and find
nothing. Every row of the query table is ranked, repeated ones too; of documents that repeat an id each counts.
Null ids sort first among equal scores. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rebuy.llm.common import partitions_of, words_of, worker_state
from rebuy.session import materialize

QUERIES, QUERY_CHARS = 512, 200_000  # queries in a block and their code points, about
SAMPLE = 8192  # documents that give the starting scores, about
TREE = 4096  # rows of a tree
LEAF = 16
STRETCH = 1 << 20  # code points of a text that are split at once
SAFE = 1e-9  # relative; sums of a million terms in doubles are off by less than 1e-9


@dataclass
class Corpus:
    """Documents as sparse rows over a block's terms, and the numbers their weights need."""

    rows: DataFrame  # doc_id, n, terms, tfs; documents with a term of the block only
    documents: int
    total: int


def _counted(text: str | None) -> tuple[int, Counter]:
    """Number of terms and their occurrences, a stretch of the text at a time."""
    found: Counter = Counter()
    at, n = 0, 0
    text = text or ""
    while at < len(text):
        end = len(text)
        if end - at > STRETCH and (space := text.find(" ", at + STRETCH)) > 0:
            end = space
        words = words_of(text[at:end])
        n += len(words)
        found.update(words)
        at = end
    return n, found


def sparse_rows(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, and the numbers and occurrences of ``terms``, for every document with at least one term of any kind."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    shipped = spark.sparkContext.broadcast(terms)
    name = f"terms:{uuid.uuid4().hex}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = worker_state(name, lambda: {t: i for i, t in enumerate(shipped.value)})
        for batch in batches:
            keep, sizes, ends, ids, tfs = [], [], [0], [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                n, found = _counted(text)
                if not n:
                    continue
                keep.append(place)
                sizes.append(n)
                hits = sorted((number[t], found[t]) for t in found.keys() & number.keys())
                ids += [i for i, _ in hits]
                tfs += [k for _, k in hits]
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            columns = [
                batch.column(0).take(pa.array(keep, pa.int64())),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"doc_id {id_type}, n long, terms array<int>, tfs array<long>")


def term_weights(corpus: Corpus, terms: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each of the block's terms."""
    df = corpus.rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2.0 * corpus.documents + 2.0) / (2 * F.col("df") + 1).cast("double")
    weights = np.zeros(terms, dtype=np.int64)
    for row in df.select("term", F.floor(1000 * F.log(ratio)).alias("w")).toLocalIterator():
        weights[row.term] = row.w
    return weights  # a term of no document keeps 0; no document can score by it


@dataclass
class Tree:
    """Nodes in one array each; children of node i are ``first[i]`` and ``first[i] + 1``, or none (0)."""

    first: list[int]
    rows: list[np.ndarray]
    centroid: np.ndarray  # terms x nodes
    reach: np.ndarray  # terms x nodes: centroid and the term's own radius, upwards
    radius: np.ndarray  # nodes
    present: np.ndarray  # the terms, ascending


def _dense(matrix: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the rows: which row of them, term, value."""
    ends, terms, values = matrix
    sizes = ends[rows + 1] - ends[rows]
    at = np.repeat(ends[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    return np.repeat(np.arange(len(rows)), sizes), terms[at], values[at]


def build_tree(ends: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = LEAF) -> Tree:
    """The ball tree of sparse rows with whole, positive values."""
    present, local = np.unique(terms, return_inverse=True)
    width = max(1, len(present))
    matrix = (ends, local, values.astype(np.float64))
    first, held, centroids, reaches, radii = [0], [np.arange(len(ends) - 1)], [], [], []
    node = 0
    while node < len(held):
        rows = held[node]
        row, term, value = _dense(matrix, rows)
        size = max(1, len(rows))
        centre = np.bincount(term, value, width) / size
        above = np.maximum(value - centre[term], 0.0)
        reach = np.zeros(width)
        np.maximum.at(reach, term, above)
        # Upward deviations only: terms that a row lacks lie below the centroid.
        upward = np.sqrt(np.bincount(row, above * above, size))
        centroids.append(centre)
        reaches.append((centre + reach) * (1 + SAFE))
        radii.append(upward.max() * (1 + SAFE))
        if len(rows) > leaf and radii[-1] > 0:
            norms = np.bincount(row, value * value, size)

            def far_from(point: np.ndarray) -> np.ndarray:
                return norms - 2 * np.bincount(row, value * point[term], size)

            def vector(k: int) -> np.ndarray:
                mine = row == k
                return np.bincount(term[mine], value[mine], width)

            a = vector(int(far_from(centre).argmax()))
            b = vector(int(far_from(a).argmax()))
            order = np.argsort(far_from(a) - far_from(b), kind="stable")
            first[node] = len(held)
            half = len(rows) // 2
            held += [np.sort(rows[order[:half]]), np.sort(rows[order[half:]])]
            first += [0, 0]
        node += 1
    return Tree(first, held, np.ascontiguousarray(np.array(centroids).T), np.ascontiguousarray(np.array(reaches).T), np.array(radii), present)


def search_tree(
    tree: Tree, matrix: tuple, ranks: np.ndarray, query: tuple[np.ndarray, np.ndarray], top: int, floor: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """The best rows of one query, by score and then rank, with scores of at least ``floor`` and above 0, and the leaves scored."""
    at = np.searchsorted(tree.present, query[0])
    at = np.minimum(at, max(0, len(tree.present) - 1))
    known = tree.present[at] == query[0] if len(tree.present) else np.zeros(len(at), dtype=bool)
    terms, weights = at[known], query[1][known]
    best_rows, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = max(1, floor)
    if not len(terms):
        return best_rows, best, 0
    q = weights.astype(np.float64)
    ball = q @ tree.centroid[terms] + np.sqrt(q @ q) * tree.radius
    bounds = np.minimum(ball, q @ tree.reach[terms]) * (1 + SAFE) + 1
    if bounds[0] < least:
        return best_rows, best, 0
    wanted = np.zeros(len(tree.present), dtype=np.int64)
    wanted[terms] = weights
    queue, scored = [(-bounds[0], 0)], 0
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < least:
            break
        if tree.first[node]:
            for child in (tree.first[node], tree.first[node] + 1):
                if bounds[child] >= least:
                    heapq.heappush(queue, (-min(-bound, bounds[child]), child))
            continue
        scored += 1
        rows = tree.rows[node]
        row, term, value = _dense(matrix, rows)
        sums = np.concatenate(([0], np.cumsum(wanted[term] * value)))
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(rows)))))
        scores = sums[ends[1:]] - sums[ends[:-1]]
        good = scores >= least
        if good.any():
            best_rows, best = np.concatenate((best_rows, rows[good])), np.concatenate((best, scores[good]))
            if len(best) > top:
                order = np.lexsort((ranks[best_rows], -best))[:top]
                best_rows, best = best_rows[order], best[order]
            if len(best) == top:
                least = max(least, int(best.min()))
    return best_rows, best, scored


def _search(rows: DataFrame, shipped, documents: int, total: int, top: int) -> DataFrame:
    """The best rows of every tree: query, doc_id, score."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, terms, weights, floors = shipped.value
        queries = [(terms[a:b], weights[a:b]) for a, b in zip(ends[:-1], ends[1:])]

        def answer(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            sizes = np.asarray(pc.list_value_length(table["terms"]), dtype=np.int64)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            term, tf = (np.asarray(pc.list_flatten(table[c])).astype(np.int64) for c in ("terms", "tfs"))
            n = np.asarray(table["n"], dtype=np.int64)
            m = 75 + (25 * n * documents) // total
            value = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes))
            tree = build_tree(bounds, term, value)
            matrix = (bounds, np.searchsorted(tree.present, term), value)
            ranks = np.empty(table.num_rows, np.int64)
            ranks[np.asarray(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_start"))] = np.arange(table.num_rows)
            names, rows, scores = [], [], []
            for number, query in enumerate(queries):
                found, score, _ = search_tree(tree, matrix, ranks, query, top, int(floors[number]))
                names.append(np.full(len(found), number))
                rows.append(found)
                scores.append(score)
            picked = table["doc_id"].combine_chunks().take(pa.array(np.concatenate(rows)))
            columns = [pa.array(np.concatenate(names), pa.int32()), picked, pa.array(np.concatenate(scores), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, TREE - size))
                size, at = size + held[-1].num_rows, at + held[-1].num_rows
                if size == TREE:
                    yield answer(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield answer(pa.Table.from_batches(held))

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(find, f"query int, doc_id {id_type}, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _block(spark: SparkSession, docs: DataFrame, queries: list[Counter], top: int, id_col: str, text_col: str) -> DataFrame:
    """Ranks of one block of queries, numbered by their places."""
    held = Counter(t for query in queries for t in query)
    # Terms of few queries and long terms first: a row's smallest term number is a guess at its rarest term.
    terms = sorted(held, key=lambda t: (held[t], -len(t), t))
    number = {t: i for i, t in enumerate(terms)}
    every = materialize(sparse_rows(docs, terms, id_col, text_col), "search-rows")
    totals = every.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    corpus = Corpus(every.filter(F.size("terms") > 0), totals.n, max(1, totals.l))
    rarity = term_weights(corpus, len(terms))
    entries = [sorted((number[t], k) for t, k in query.items()) for query in queries]
    ends = np.cumsum([0] + [len(e) for e in entries])
    ids = np.array([i for e in entries for i, _ in e], dtype=np.int64)
    weights = rarity[ids] * np.array([k for e in entries for _, k in e], dtype=np.int64)
    floors = np.zeros(len(queries), dtype=np.int64)

    def run(rows: DataFrame) -> DataFrame:
        shipped = spark.sparkContext.broadcast((ends, ids, weights, floors.copy()))
        return _best(_search(rows, shipped, corpus.documents, corpus.total, top), top)

    share = int(min(1.0, SAMPLE / max(1, totals.n)) * (1 << 30))
    drawn = corpus.rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(share))
    for row in run(drawn).filter(F.col("rank") == top).select("query", "score").collect():
        floors[row["query"]] = row.score
    parts = partitions_of(spark)
    laid_out = corpus.rows.withColumn("head", F.get("terms", F.lit(0)))
    laid_out = laid_out.repartitionByRange(parts, "head", F.xxhash64("terms"), "doc_id").sortWithinPartitions("head", "terms", "doc_id")
    return run(laid_out)


def search(
    docs: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text"
) -> DataFrame:
    """The ``top`` documents of every query with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    item_type = queries.schema[item_col].dataType.simpleString()
    id_type = docs.schema[id_col].dataType.simpleString()
    asked = queries.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // QUERIES), -(-size.chars // QUERY_CHARS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    result = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for block in range(blocks):
        items = [(r.item_id, _counted(r.text)[1]) for r in asked.filter(F.col("block") == block).select("item_id", "text").collect()]
        items = [(i, c) for i, c in items if c]
        if not items:
            continue
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], f"query int, item_id {item_type}")
        found = materialize(_block(spark, docs, [c for _, c in items], top, id_col, text_col), "search-found")
        result = result.unionByName(found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return result
