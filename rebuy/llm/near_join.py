"""Near-duplicate join on word shingles with Bayesian pruning of candidates.

Documents are sets of five-word shingles (all words of a shorter text are one shingle). Documents
with equal sets form one class and take part once. Classes that share a band of MinHash values are
candidates. A pair's MinHash values are compared a few at a time; after m matches in n the pair is
dropped once the posterior probability of reaching the threshold, under a uniform prior, is below
the tolerance. The rest is verified exactly on the shingle sets.

Large groups of near copies are never listed pair by pair:

* Bands with many classes are cut into blocks, and each pair of blocks is one unit of work. A unit
  returns a spanning forest of its surviving pairs, so what it emits is linear in its members.
* The components of these forests contain every candidate pair that survives. Each component is
  again cut into blocks; a unit compares its members' signatures, verifies the surviving pairs with
  one product of incidence matrices, and returns each member's links and another forest.
* The components of the verified forests are the groups.

What can be lost: a pair at the threshold exactly shares no band with probability (1 - 0.8^4)^24,
about 3 in a million, and is pruned wrongly with about the tolerance. Both are lower for closer pairs.

Defined cases: texts without words (null, empty) have no shingles and link to nothing; each is its
own group. Rows with the same id are separate documents; null ids sort below all others. A group's
id is its smallest id (null only if it has no other). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rebuy.llm.common import Memo, ascii_lower, partitions_of, words_of, worker_memo, worker_state
from rebuy.llm.components import connected_components
from rebuy.operators.skew import fits_broadcast
from rebuy.session import materialize

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
TOLERANCE = 1e-6
HASHES = 128
ROWS_PER_BAND = 4
BANDS = 24
STEP = 32  # MinHash values compared at a time
BAND_BLOCK = 512  # classes of a band in one block
GROUP_BLOCK = 192  # classes of a component in one block
SMALL = 32  # units up to this size are handled together
WORDS_REMEMBERED = 500_000

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    memo = worker_memo("word-hashes", lambda: Memo(_word_hash, WORDS_REMEMBERED))
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        out = _mix(out * _MUL + hashes[k : k + n])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    draw = lambda: rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)
    return draw()[:, None], (draw() | np.uint64(1))[:, None]


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    flips, factors = worker_state("permutations", _permutations)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = (shingles[None, at : at + 2048] ^ flips) * factors
        np.minimum(least, part.min(axis=1), out=least)
    return _mix(least)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    rows = hashes[: BANDS * ROWS_PER_BAND].reshape(BANDS, ROWS_PER_BAND)
    for k in range(ROWS_PER_BAND):
        keys = _mix(keys * _MUL + rows[:, k])
    return keys.view(np.int64)


def needed_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the matches from which a pair is kept.

    Signatures keep one byte of each MinHash value, so a pair of similarity s
    matches with probability p = s + (1 - s) / 256. With a uniform prior on p,
    P(p >= t | m of n) is the chance of at most m successes in n + 1 trials.
    """
    t = float(threshold) + (1 - float(threshold)) / 256
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def surviving_pairs(signatures: np.ndarray, i: np.ndarray, j: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Mask of the pairs (i, j) that no comparison step drops."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for n, least in needed.items():
        part = slice(n - STEP, n)
        matches = matches + (signatures[i[alive], part] == signatures[j[alive], part]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    mask = np.zeros(len(i), bool)
    mask[alive] = True
    return mask


def surviving_matrix(left: np.ndarray, right: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """The same for all pairs of two blocks, first by a matrix of matches in the first step."""
    first = np.zeros((len(left), len(right)), np.uint8)
    for k in range(STEP):
        first += left[:, k][:, None] == right[:, k][None, :]
    i, j = np.nonzero(first >= needed[STEP])
    out = np.zeros(first.shape, bool)
    both, offset = np.concatenate([left, right]), len(left)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        mask = surviving_pairs(both, a, b + offset, needed)
        out[a[mask], b[mask]] = True
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and edges (i, j), the smallest node that each is connected with."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return label


def common_counts(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of sets[:cut] with sets[cut:], by products of incidence matrices."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    vocabulary, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    member, column = member[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((cut, len(sets) - cut), np.float64)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[member[lo:hi], column[lo:hi] - at] = 1
        out += part[:cut] @ part[cut:].T
    return np.rint(out).astype(np.int64)


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their first ``keys`` columns, as tables of whole units with the units' first rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def bounds(data: pa.Table) -> np.ndarray:
        change = np.zeros(data.num_rows, bool)
        change[0] = True
        for k in range(keys):
            column = data.column(k).combine_chunks()
            column = column if not isinstance(column, pa.ChunkedArray) else column.chunk(0)
            if pa.types.is_binary(column.type):
                codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            else:
                codes = column.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if not batch.num_rows:
            continue
        data = pa.Table.from_batches(held)
        firsts = bounds(data)
        if len(firsts) > 1:
            whole = int(firsts[-1])
            yield data.slice(0, whole), firsts[:-1]
            held = data.slice(whole).to_batches()
    if held and sum(b.num_rows for b in held):
        data = pa.Table.from_batches(held)
        yield data, bounds(data)


def _bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _describe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document its class (a digest of its shingle set), signature and band keys."""
    id_type = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, signatures, bands = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text)
                if not len(shingles):
                    digests.append(None), signatures.append(None), bands.append(None)
                    continue
                hashes = min_hashes(shingles)
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                signatures.append((hashes & np.uint64(0xFF)).astype(np.uint8).tobytes())
                bands.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "cls", "signature", "bands"],
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {id_type}, cls binary, signature binary, bands array<long>")


def _blocks(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Adds lo, hi and block: each row goes to all pairs of blocks that its own block is part of."""
    rows = rows.withColumn("n_blocks", F.ceil(F.col(size) / F.lit(block)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    rows = rows.withColumn("other", other)
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "n_blocks")


def _candidate_edges(classes: DataFrame) -> DataFrame:
    """Spanning forests of the surviving candidate pairs of every band."""
    needed = needed_matches()
    light = classes.select("cls", F.explode("bands").alias("band"))
    counts = light.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = light.join(counts, "band").join(classes.select("cls", "signature"), "cls")
    units = _blocks(shared, "n", BAND_BLOCK).select("band", "lo", "hi", "block", "cls", "signature")
    units = units.repartition(partitions_of(classes.sparkSession), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, firsts in _units(batches, 3):
            signatures, cls = _bytes_matrix(data.column("signature"), HASHES), data.column("cls").to_pylist()
            lo, hi, block = (data.column(c).to_numpy() for c in ("lo", "hi", "block"))
            sizes = np.diff(np.append(firsts, data.num_rows))
            edges_i, edges_j = [], []
            for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
                a, b = np.triu_indices(size, 1)
                start = firsts[sizes == size]
                i, j = (start[:, None] + a).ravel(), (start[:, None] + b).ravel()
                cross = (lo[i] == hi[i]) | (block[i] != block[j])
                i, j = i[cross], j[cross]
                mask = surviving_pairs(signatures, i, j, needed)
                edges_i.append(i[mask])
                edges_j.append(j[mask])
            for start, size in zip(firsts[sizes > SMALL], sizes[sizes > SMALL]):
                rows = np.arange(start, start + size)
                left = rows if lo[start] == hi[start] else rows[block[rows] == lo[start]]
                right = rows if lo[start] == hi[start] else rows[block[rows] == hi[start]]
                i, j = np.nonzero(surviving_matrix(signatures[left], signatures[right], needed))
                edges_i.append(left[i])
                edges_j.append(right[j])
            if not edges_i:
                continue
            label = forest(data.num_rows, np.concatenate(edges_i), np.concatenate(edges_j))
            moved = np.flatnonzero(label != np.arange(data.num_rows))
            pairs = {(cls[k], cls[label[k]]) for k in moved.tolist()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"]
            )

    return units.mapInArrow(compare, "a binary, b binary")


def _sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the documents whose ids are wanted."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    rows = rows.join(side, rows["doc_id"].eqNullSafe(side["rep_id"]), "left_semi")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text) for text in batch.column(0).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"]
            )

    return rows.select("text").mapInArrow(scan, "cls binary, shingles binary").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _verified(members: DataFrame) -> DataFrame:
    """Per unit and class: linked documents and classes of the unit, and a class that it is connected with."""
    needed, num, den = needed_matches(), THRESHOLD.numerator, THRESHOLD.denominator
    units = _blocks(members, "size", GROUP_BLOCK).select("comp", "lo", "hi", "block", "cls", "n", "signature", "shingles")
    units = units.repartition(partitions_of(members.sparkSession), "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, firsts in _units(batches, 3):
            out = {"cls": [], "root": [], "documents": [], "classes": []}
            for start, end in zip(firsts, np.append(firsts[1:], data.num_rows)):
                unit = data.slice(start, end - start)
                lo, hi = unit.column("lo")[0].as_py(), unit.column("hi")[0].as_py()
                block, n = unit.column("block").to_numpy(), unit.column("n").to_numpy()
                signatures, cls = _bytes_matrix(unit.column("signature"), HASHES), unit.column("cls").to_pylist()
                sets = [np.frombuffer(s, np.uint64) for s in unit.column("shingles").to_pylist()]
                left = np.arange(len(cls)) if lo == hi else np.flatnonzero(block == lo)
                right = np.arange(len(cls)) if lo == hi else np.flatnonzero(block == hi)
                kept = surviving_matrix(signatures[left], signatures[right], needed)
                if lo == hi:
                    np.fill_diagonal(kept, False)
                if not kept.any():
                    continue
                common = common_counts([sets[k] for k in left] + [sets[k] for k in right], len(left))
                sizes = np.array([len(s) for s in sets])
                union = sizes[left][:, None] + sizes[right][None, :] - common
                linked = kept & (den * common >= num * union)
                i, j = np.nonzero(linked)
                documents, classes = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
                documents[left] += linked @ n[right]
                classes[left] += linked.sum(axis=1)
                if lo != hi:
                    documents[right] += linked.T @ n[left]
                    classes[right] += linked.sum(axis=0)
                label = forest(len(cls), left[i], right[j])
                for k in np.flatnonzero(classes):
                    out["cls"].append(cls[k])
                    out["root"].append(cls[label[k]])
                    out["documents"].append(int(documents[k]))
                    out["classes"].append(int(classes[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["cls"], pa.binary()), pa.array(out["root"], pa.binary()), pa.array(out["documents"], pa.int64()), pa.array(out["classes"], pa.int64())],
                ["cls", "root", "documents", "classes"],
            )

    return units.mapInArrow(verify, "cls binary, root binary, documents long, classes long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document.

    doc_id; class_id, the smallest id of its group of linked documents;
    n_links, the other documents that it is linked with (copies included);
    copy_id, the smallest id with an equal shingle set; n_copies, how many
    documents have that set.
    """
    described = materialize(_describe(df, id_col, text_col), "near-documents")
    classes = (
        described.filter("cls is not null")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    )
    classes = materialize(classes, "near-classes")
    comps = connected_components(_candidate_edges(classes), "near-candidates")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = comps.join(sizes, "comp").withColumnRenamed("node", "cls")
    members = materialize(members.join(classes.select("cls", "rep_id", "n", "signature"), "cls"), "near-members")
    sets = _sets(df, id_col, text_col, materialize(members.select("rep_id"), "near-wanted"))
    links = materialize(_verified(members.drop("rep_id").join(sets, "cls")), "near-links")

    groups = connected_components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")), "near-groups")
    linked = links.groupBy("cls").agg(F.sum("documents").alias("documents"))
    base = classes.select("cls", "rep_id", "n")
    grouped = groups.select(F.col("node").alias("cls"), "comp").join(base, "cls")
    ids = grouped.groupBy("comp").agg(F.min("rep_id").alias("class_id"))
    grouped = grouped.join(ids, "comp").select("cls", "class_id")
    # Classes of one document without a link need no entry: the document is its own group.
    info = (
        base.join(grouped, "cls", "left")
        .join(linked, "cls", "left")
        .filter("n > 1 or documents is not null")
        .select(
            "cls",
            F.when(F.col("documents").isNull(), F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"),
            (F.coalesce("documents", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
            F.col("rep_id").alias("copy_id"),
            F.col("n").alias("n_copies"),
        )
    )
    info = materialize(info, "near-info")
    # Classes of so many copies that they would fill a task; there are fewer than four per task, whatever the data.
    tasks = partitions_of(df.sparkSession)
    large = F.col("n_copies") > classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n / (4 * tasks)
    few, documents = F.broadcast(info.filter(large)), described.select("doc_id", "cls")
    rest = documents.join(few, "cls", "left_anti").join(info.filter(~large), "cls", "left")
    joined = documents.join(few, "cls").unionByName(rest)
    alone = F.col("n_copies").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
    )


def near_deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each group, that of the smallest id, with all their columns."""
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    keyed = df.withColumn("__key", F.struct(F.col(id_col).alias("id"), sha.alias("sha")))
    kept = near_duplicates(keyed, "__key", text_col).filter("doc_id <=> class_id")
    kept = kept.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.sha").alias("__sha")).distinct()
    rows = df.withColumns({"__own": F.col(id_col), "__text": sha})
    matched = rows.join(kept, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha")), "left_semi")
    one = Window.partitionBy("__own", "__text").orderBy(F.lit(0))
    return matched.withColumn("__n", F.row_number().over(one)).filter("__n = 1").select(*df.columns)
