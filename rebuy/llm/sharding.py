"""Uniform shuffle into shards of exact size (DataFrame operations only).

Law ``rows``: shard sizes differ by one row at most, and every assignment that keeps these sizes
is equally likely. The rows of a source block are permuted locally; how many of them go to each
destination is drawn from the multivariate hypergeometric law, one block after another, so every
destination is filled exactly; after the exchange each destination is permuted again.

A destination is a stretch of a shard, so a shard of any size is shuffled by many tasks. Blocks
and destinations are bounded, and with them the matrix that the driver draws: it holds counts
only. The rows' places in their blocks are stored before they are counted, so a lost executor
cannot change them.

Defined cases: repeated rows and null ids are rows like any other. With fewer rows than shards
some shards stay empty. An empty table gives an empty result. Columns of the input that are
named like the added ones (shard, slot) are replaced.
"""

from __future__ import annotations

import decimal
import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from rebuy.llm.common import count_not_above, partitions_of
from rebuy.session import materialize

GENERATOR_LIMIT = 10**9  # of numpy's hypergeometric generator, on either side of the urn
HALF = decimal.Decimal("0.5")
# ln(sqrt(2 pi)), and the coefficients of Stirling's series.
LOG_ROOT_TAU = decimal.Decimal("0.9189385332046727417803297364056176398613974736377834128171")
STIRLING = [(1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400)]
MAX_BLOCKS = 2048
MAX_DESTINATIONS = 2048


def destination_sizes(rows: int, shards: int, stretches: int) -> list[list[int]]:
    """Sizes of every shard's stretches: shards differ by one at most, and so do a shard's stretches."""
    per_shard = [rows // shards + (s < rows % shards) for s in range(shards)]
    return [[n // stretches + (j < n % stretches) for j in range(stretches)] for n in per_shard]


def communication_matrix(block_rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each destination; row and column sums are exact."""
    rng, left, out = np.random.default_rng(seed), np.array(sizes, dtype=np.int64), []
    for n in block_rows:
        drawn = _hypergeometric(rng, left, n)
        left = left - drawn
        out.append(drawn)
    return np.array(out, dtype=np.int64).reshape(len(block_rows), len(sizes))


def _hypergeometric(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Colours of ``n`` balls drawn from an urn: the urn is halved again and again."""
    if len(left) == 1:
        return np.array([n], dtype=np.int64)
    half = len(left) // 2
    good, bad = int(left[:half].sum()), int(left[half:].sum())
    first = _draw(rng, good, bad, n)
    return np.concatenate([_hypergeometric(rng, left[:half], first), _hypergeometric(rng, left[half:], n - first)])


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0 or n == good + bad:
        return min(n, good)
    if max(good, bad) < GENERATOR_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    return _draw_large(rng, good, bad, n)


def _draw_large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same law for urns beyond the generator's limit: ratio of uniforms (Stadlober, 1990).

    A proposal is accepted by its exact probability against that of the most likely number. Logarithms
    of factorials are taken in doubles; where their rounding could matter, in 40 decimal digits.
    """
    total = good + bad
    least, most = max(0, n - bad), min(n, good)
    mode = (n + 1) * (good + 1) // (total + 2)
    share = good / total
    spread = math.sqrt(n * share * (1 - share) * (total - n) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        offset = math.floor(n * share + 0.5 + width * (v - 0.5) / u - mode)
        k = mode + offset
        if not least <= k <= most:
            continue
        terms = [(mode, k), (good - mode, good - k), (n - mode, n - k), (bad - n + mode, bad - n + k)]
        gap = sum(math.lgamma(a + 1) - math.lgamma(b + 1) for a, b in terms) - 2 * math.log(u)
        # lgamma is good to some 1e-15 of its value, which is below 30 times the number of rows.
        if abs(gap) < 1e-12 * total:
            with decimal.localcontext(prec=40):
                gap = sum(_log_factorial(a) - _log_factorial(b) for a, b in terms) - 2 * decimal.Decimal(u).ln()
        if gap >= 0:
            return k


def _log_factorial(n: int) -> decimal.Decimal:
    """Stirling's series; its error is below 1e-35 from 256 on."""
    if n < 256:
        return decimal.Decimal(math.factorial(n)).ln()
    x = decimal.Decimal(n)
    out = (x + HALF) * x.ln() - x + LOG_ROOT_TAU
    for power, (above, below) in enumerate(STIRLING):
        out += decimal.Decimal(above) / (decimal.Decimal(below) * x ** (2 * power + 1))
    return out


def exact_shuffle(df: DataFrame, shards: int, seed: int = 20240601, stretches: int | None = None) -> DataFrame:
    """``df`` with columns shard (0 to shards - 1) and slot (0, 1, ... in each shard)."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    if stretches is None:
        stretches = max(1, min(math.ceil(2 * partitions_of(spark) / shards), MAX_DESTINATIONS // shards))
    marked = df.select(*columns).withColumn("__row", F.monotonically_increasing_id())
    # The upper bits of the row number are the partition it was read in.
    placed = marked.withColumn("__block", F.pmod(F.shiftright("__row", 33), F.lit(MAX_BLOCKS)).cast("int"))
    stored = materialize(placed, "shard-rows")
    counts = sorted((r["__block"], r["n"]) for r in stored.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = destination_sizes(sum(n for _, n in counts), shards, stretches)
    flat = [n for shard in sizes for n in shard]
    matrix = communication_matrix([n for _, n in counts], flat, seed)
    ends = [(block, [int(x) for x in np.cumsum(row)]) for (block, _), row in zip(counts, matrix)]
    firsts = [(s, s * stretches + j, sum(shard[:j])) for s, shard in enumerate(sizes) for j in range(stretches)]
    ends_df = spark.createDataFrame(ends, "__block int, __ends array<long>")
    firsts_df = spark.createDataFrame(firsts, "shard int, __to int, __first long")

    def shuffled(salt: int):
        return F.xxhash64(F.lit(seed + salt), "__row")

    local = Window.partitionBy("__block").orderBy(shuffled(1), "__row")
    dealt = (
        stored.withColumn("__rank", F.row_number().over(local).cast("long") - 1)
        .join(ends_df, "__block")
        .withColumn("__to", count_not_above(F.col("__ends"), F.col("__rank"), max(2, math.isqrt(len(flat)))).cast("int"))
        .drop("__ends")
    )
    again = Window.partitionBy("__to").orderBy(shuffled(2), "__row")
    # One row per destination, MAX_DESTINATIONS at most.
    return (
        dealt.withColumn("__again", F.row_number().over(again).cast("long") - 1)
        .join(F.broadcast(firsts_df), "__to")
        .select(*columns, "shard", (F.col("__first") + F.col("__again")).alias("slot"))
    )


def write_shards(df: DataFrame, shards: int, path: str, seed: int = 20240601) -> None:
    """Write whole rows as Parquet, one folder per shard, in slot order inside each file."""
    placed = exact_shuffle(df, shards, seed)
    stretch = F.floor(F.col("slot") / F.lit(1 << 20))
    dealt = placed.repartition(partitions_of(df.sparkSession), "shard", stretch)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
