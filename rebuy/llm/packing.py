"""Packing documents into sequences of at most ``capacity`` tokens by linear grouping.

1. A document longer than the capacity is cut into pieces of the capacity and a rest.
2. Large pieces, ordered by length, form groups of equal cardinality; lengths are rounded up to
   the largest of their group, so few sizes are left. Column generation finds configurations of
   these sizes (sets that fit one sequence) that cover all groups with the fewest sequences.
3. The actual pieces of each group take the places of its rounded size.
4. Small pieces, and the few large ones that whole numbers of configurations leave over, go by
   decreasing length to the fullest sequence that still has room.

Rounding wastes the room between a piece and its group's size unless small pieces fill it, so how
long a large piece is, how much room configurations leave, and how many of the configurations of several
pieces are used is decided by planning each of ``SETTINGS`` on the histogram of lengths. The plan that
needs the fewest sequences is carried out; of equally good ones the first, which uses most configurations.

The driver sees histograms only: of piece lengths and of free room, ``capacity`` entries at most.
It answers with stretches of positions ("pieces of length 700 at positions 10 to 90 of the order
go to sequences 400 to 480"), a number that depends on the capacity and the number of groups, not
on the data. Positions are numbered in salted blocks, so many pieces of one length are no hot key.

Defined cases: a null or empty text is one piece that holds only the end id. Null ids and rows
that repeat an id are documents like any other (``piece`` then repeats too). An empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rebuy.llm.tokens import encoder
from rebuy.session import materialize

GROUPS = 64
# What counts as large (longer than capacity / n), the share of a sequence that configurations leave free for small
# pieces (capacity / n, 0 for none), and the share of the configurations of several pieces that is used; pieces of
# the others are left to best fit. The plan with the fewest sequences wins, the first of these if there are several.
SHARES = (0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.1)
SETTINGS = ((4, 8, 1.0), (8, 0, 1.0), (3, 8, 1.0), *((3, 8, share) for share in SHARES), (2, 0, 1.0))
SALTS = 64
ROUNDS = 4000  # of column generation; a bound against cycling


def pieces(df: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(vocabulary).texts, np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            source, piece, start, length, checksum, data = [], [], [], [], [], []
            for row, ids in enumerate(encode(batch.column(1))):
                ids += end
                for number, at in enumerate(range(0, len(ids), step)):
                    source.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    part = ids[at : at + step]
                    length.append(len(part) // 4)
                    checksum.append(zlib.crc32(part))
                    if with_ids:
                        data.append(part)
            columns = [
                batch.column(0).take(pa.array(source, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(checksum, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(d, "<u4").tolist() for d in data], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(cut, schema)


# ---- the plan, from histograms ----


def equal_groups(large: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """(rounded size, pieces) of groups of equal cardinality; ``large`` is a histogram by decreasing length."""
    total = sum(n for _, n in large)
    if not total:
        return []
    each = -(-total // min(groups, total))
    lengths, before = [], [0]
    for length, n in large:
        lengths.append(length)
        before.append(before[-1] + n)
    return [(lengths[bisect.bisect_right(before, at) - 1], min(each, total - at)) for at in range(0, total, each)]


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and is worth most (unbounded knapsack)."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_up, values_up = sizes[order], values[order]
    fits = np.searchsorted(sizes_up, np.arange(capacity + 1), side="right")
    for room in range(int(sizes_up[0]), capacity + 1):
        worth = best[room - sizes_up[: fits[room]]] + values_up[: fits[room]]
        k = int(worth.argmax())
        if worth[k] > best[room - 1] + 1e-12:
            best[room], taken[room] = worth[k], k
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
            continue
        counts[order[taken[room]]] += 1
        room -= int(sizes_up[taken[room]])
    return float(best[capacity]), counts


@functools.lru_cache(maxsize=8)
def configurations(groups: tuple[tuple[int, int], ...], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {group: pieces in each}) from the linear relaxation, numbers of sequences rounded down."""
    if not groups:
        return []
    sizes = np.array([s for s, _ in groups], dtype=np.int64)
    demand = np.array([float(n) for _, n in groups])
    basis = np.diag((capacity // sizes).astype(float))
    used = np.linalg.solve(basis, demand)
    for _ in range(ROUNDS):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = _best_configuration(sizes, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, column)
        ratio = np.full(len(sizes), np.inf)
        np.divide(np.maximum(used, 0), change, out=ratio, where=change > 1e-9)
        leaving = int(ratio.argmin())
        used = used - ratio[leaving] * change
        used[leaving] = ratio[leaving]
        basis[:, leaving] = column
    left, out = [n for _, n in groups], []
    for k in np.argsort(-used):
        content = {int(g): int(round(m)) for g, m in enumerate(basis[:, k]) if m > 0.5}
        times = min([int(used[k] + 1e-6), *(left[g] // m for g, m in content.items())])
        if times > 0 and content:
            out.append((times, content))
            for g, m in content.items():
                left[g] -= times * m
    return out


class Stretches:
    """Unassigned positions of each length, as intervals of the order by decreasing length."""

    def __init__(self, histogram: list[tuple[int, int]]):
        self.free: dict[int, list[list[int]]] = {}
        at = 0
        for length, n in histogram:
            self.free[length] = [[at, at + n]]
            at += n

    def take(self, length: int, n: int) -> list[tuple[int, int]]:
        out, free = [], self.free[length]
        while n:
            start, end = free[0]
            got = min(n, end - start)
            out.append((start, start + got))
            free[0][0] += got
            if free[0][0] == end:
                free.pop(0)
            n -= got
        return out

    def count(self, length: int) -> int:
        return sum(b - a for a, b in self.free[length])


Plan = tuple[list[tuple], Stretches, int]


def plan_large(histogram: list[tuple[int, int]], capacity: int, setting: tuple[int, int, float], groups: int = GROUPS) -> Plan:
    """Stretches of the order for full and large pieces: (length, from, to, first place, base, sequences).

    The piece at position p takes place ``first + p - from``, and goes to
    sequence ``base + place % sequences``. Also returns the positions that are
    left and the number of sequences.
    """
    rest, out, base = Stretches(histogram), [], 0
    if histogram and histogram[0][0] == capacity:
        base = histogram[0][1]
        rest.take(capacity, base)
        out.append((capacity, 0, base, 0, 0, base))
    large = [(length, n) for length, n in histogram if capacity // setting[0] < length < capacity]
    spans = {length: tuple(rest.free[length][0]) for length, _ in large}
    usable = capacity - (capacity // setting[1] if setting[1] else 0)
    # A size beyond what configurations may use takes a sequence of its own.
    cut = [(min(size, usable), n) for size, n in equal_groups(large, groups)]
    nexts, at = [], base
    for _, n in cut:
        nexts.append(at)
        at += n
    assigned: list[tuple[int, int]] = []
    for times, content in configurations(tuple(cut), usable):
        if sum(content.values()) > 1:
            times = int(times * setting[2])
        if not times:
            continue
        for g, m in content.items():
            begin, end = nexts[g], nexts[g] + times * m
            nexts[g] = end
            assigned.append((begin, end))
            for length, (a, b) in spans.items():
                if a < end and b > begin:
                    out.append((length, max(a, begin), min(b, end), max(a, begin) - begin, base, times))
        base += times
    assigned.sort()
    for length, (a, b) in spans.items():
        gaps, at = [], a
        for begin, end in assigned:
            if end <= at or begin >= b:
                continue
            if begin > at:
                gaps.append([at, begin])
            at = min(end, b)
        if at < b:
            gaps.append([at, b])
        rest.free[length] = gaps
    return out, rest, base


def room_left(stretches: list[tuple], base: int, capacity: int) -> list[tuple[int, int]]:
    """(free room, sequences) of the first ``base`` sequences, from where the stretches' fill changes."""
    changes: dict[tuple[int, int], dict[int, int]] = {}
    for length, a, b, place, first, bins in stretches:
        change = changes.setdefault((first, bins), defaultdict(int))
        whole, more = divmod(b - a, bins)
        begin, end = place % bins, place % bins + more
        change[0] += whole * length + (length if end > bins else 0)
        change[begin] += length if more else 0
        change[end % bins if end > bins else end] -= length if more else 0
    out: dict[int, int] = defaultdict(int)
    out[capacity] = base - sum(bins for _, bins in changes)
    for (_, bins), change in changes.items():
        places, used = sorted({*change, bins}), 0
        for at, following in zip(places, places[1:]):
            used += change.get(at, 0)
            out[capacity - used] += following - at
    return [(free, n) for free, n in sorted(out.items()) if n]


def sequences_needed(histogram: list[tuple[int, int]], capacity: int, setting: tuple[int, int, float], groups: int) -> int:
    """How many sequences a setting takes, by carrying out its plan on the histogram."""
    stretches, rest, base = plan_large(histogram, capacity, setting, groups)
    small, _ = plan_rest(rest, room_left(stretches, base, capacity), capacity)
    return max([base, *(s[4] + s[5] for s in small)])


def choose_setting(histogram: list[tuple[int, int]], capacity: int, groups: int = GROUPS) -> tuple[int, int, float]:
    least = -(-sum(length * n for length, n in histogram) // capacity)
    best = None
    for setting in SETTINGS:
        need = sequences_needed(histogram, capacity, setting, groups)
        if best is None or need < best[0]:
            best = (need, setting)
        if need == least:
            break
    return best[1]


def configured_share(histogram: list[tuple[int, int]], capacity: int, setting: tuple[int, int, float], groups: int = GROUPS) -> float:
    """The share of sequences that begin as a configuration of two or more large pieces."""
    stretches, _, _ = plan_large(histogram, capacity, setting, groups)
    pieces: dict[tuple[int, int], int] = defaultdict(int)
    for _, a, b, _, first, bins in stretches:
        pieces[(first, bins)] += b - a
    several = sum(bins for (_, bins), n in pieces.items() if n >= 2 * bins)
    return several / max(1, sequences_needed(histogram, capacity, setting, groups))


def plan_rest(rest: Stretches, room: list[tuple[int, int]], capacity: int) -> tuple[list[tuple], dict[int, int]]:
    """Best fit by decreasing length, for whole classes of equal sequences at a time.

    ``room`` counts the sequences there are by free room. Returns stretches as
    in ``plan_large`` and the first sequence number of each class of free
    room: a class's sequences are numbered by their rank in it.
    """
    first, number = {}, 0
    classes: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by room left: [base, sequences]
    for free, n in sorted(room):
        first[free] = number
        classes[free].append([number, n])
        number += n
    filled = sorted(free for free, n in room if n)
    out = []

    def put(free: int, kind: list[int]) -> None:
        if not classes[free] and (not (k := bisect.bisect_left(filled, free)) < len(filled) or filled[k] != free):
            filled.insert(bisect.bisect_left(filled, free), free)
        classes[free].append(kind)

    for length in sorted(rest.free, reverse=True):
        n = rest.count(length)
        while n:
            k = bisect.bisect_left(filled, length)
            if k == len(filled):
                each = min(capacity // length, n)
                bins = n // each
                free, kind = capacity, [number, bins]
                number += bins
            else:
                free = filled[k]
                kind = classes[free].pop()
                if not classes[free]:
                    filled.pop(k)
                each = min(free // length, n)
                bins = min(kind[1], n // each)
                if bins < kind[1]:
                    put(free, [kind[0] + bins, kind[1] - bins])
                    kind = [kind[0], bins]
            place = 0
            for a, b in rest.take(length, each * bins):
                out.append((length, a, b, place, kind[0], bins))
                place += b - a
            put(free - each * length, kind)
            n -= each * bins
    return out, first


# ---- the plan, applied ----


def _numbered(df: DataFrame, key: str, salt: Column, order: list) -> DataFrame:
    """``rank`` of each row among those with its ``key``, from 0, without gathering a key in one task."""
    salted = df.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    here = Window.partitionBy(key, "salt")
    ranked = salted.withColumn("__n", F.row_number().over(here.orderBy(*order)).cast("long") - 1)
    # SALTS rows per key at most; keys are lengths.
    counts = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.withColumn("__b", F.sum("__c").over(Window.partitionBy(key).orderBy("salt")) - F.col("__c"))
    return ranked.join(before.drop("__c"), [key, "salt"]).withColumn("rank", F.col("__n") + F.col("__b")).drop("salt", "__n", "__b")


def _assign(numbered: DataFrame, stretches: list[tuple], spark: SparkSession) -> DataFrame:
    columns = "s_length long, s_from long, s_to long, s_place long, s_base long, s_bins long"
    lookup = spark.createDataFrame(stretches, columns)
    at = F.col("position")
    match = (F.col("length") == F.col("s_length")) & (at >= F.col("s_from")) & (at < F.col("s_to"))
    # Bounded by the capacity and the number of groups, whatever the data.
    joined = numbered.join(F.broadcast(lookup), match)
    return joined.withColumn("bin", F.col("s_base") + F.pmod(F.col("s_place") + at - F.col("s_from"), F.col("s_bins"))).drop(*lookup.columns)


def _histogram(df: DataFrame, column: str) -> list[tuple[int, int]]:
    return [(r[column], r["n"]) for r in df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()]


def pack(cut: DataFrame, capacity: int, groups: int = GROUPS) -> DataFrame:
    """``cut`` (doc_id, piece, length and more) with sequence_id and offset of each piece.

    ``cut`` is read several times and should be a stored table.
    """
    spark = cut.sparkSession
    histogram = sorted(_histogram(cut, "length"), reverse=True)
    stretches, rest, _ = plan_large(histogram, capacity, choose_setting(histogram, capacity, groups), groups)
    place = F.xxhash64("doc_id", "piece")
    order = [place, F.col("doc_id").asc_nulls_first(), F.col("piece"), *[F.col(c) for c in cut.columns if c in ("start", "ids_crc32")]]
    starts, at = [], 0
    for length, n in histogram:
        starts.append((length, at))
        at += n
    begins = spark.createDataFrame(starts, "length long, begins long")
    numbered = _numbered(cut, "length", place, order).join(F.broadcast(begins), "length")
    numbered = materialize(numbered.withColumn("position", F.col("begins") + F.col("rank")).drop("begins", "rank"), "pack-pieces")

    large = _assign(numbered, stretches, spark)
    bins = large.groupBy("bin").agg((F.lit(capacity) - F.sum("length")).alias("free"))
    bins = materialize(_numbered(bins, "free", F.xxhash64("bin"), [F.col("bin")]), "pack-bins")
    small, first = plan_rest(rest, _histogram(bins, "free"), capacity)
    firsts = spark.createDataFrame(list(first.items()), "free long, first long")
    renamed = bins.join(F.broadcast(firsts), "free").select("bin", (F.col("first") + F.col("rank")).alias("sequence_id"))
    columns = [*cut.columns, "sequence_id"]
    placed = large.join(renamed, "bin").select(*columns)
    placed = placed.unionByName(_assign(numbered, small, spark).withColumnRenamed("bin", "sequence_id").select(*columns))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces that carry their ids: sequence_id, ids, doc_ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
