"""Joins to a lookup table, whose other side may hold one key very often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

# A key is hot if it holds more than a 1 / FINENESS of what a task gets on average; its rows are
# spread over so many salts that each holds no more than that.
FINENESS = 4
FAN_OUT = 32  # of rows without a key
# Stored (compressed) size up to which a lookup table is sent to every executor.
BROADCAST_BYTES = 16 << 20


def heaviest(df: DataFrame, key: str, weight: str, tasks: int | None = None) -> DataFrame:
    """The hot keys of a stored table of keys and weights, and over how many salts each is spread (``copies``).

    There are fewer than FINENESS keys per task, whatever the data.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.agg(F.sum(weight).cast("double").alias("total")).first().total or 0.0
    share = F.col(weight) * F.lit(float(FINENESS * tasks) / max(total, 1e-300))
    return df.filter(share > 1).select(key, F.ceil(share).cast("int").alias("copies"))


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a stored table this is the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(lookup: DataFrame) -> bool:
    return stored_bytes(lookup) <= BROADCAST_BYTES


def lookup_join(
    left: DataFrame, lookup: DataFrame, key: str, hot: Callable[[], DataFrame], spread_by: str, how: str = "inner"
) -> DataFrame:
    """Join to a table with one row per ``key``: broadcast if its size allows, else spread.

    ``hot`` names the heavy keys; it is only asked for when it is needed.
    """
    if fits_broadcast(lookup):
        return left.join(F.broadcast(lookup), key, how)
    return spread_join(left, lookup, key, hot(), spread_by, how)


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to the lookup table ``right`` (one row per ``key``) by shuffling.

    Rows of the ``hot`` keys are spread by ``spread_by`` over as many salts as their weight asks for, and
    only those lookup rows are repeated; rows without a key are spread over ``FAN_OUT``. ``hot`` is the
    bounded output of :func:`heaviest`, so it can always be broadcast.
    """
    flag = F.broadcast(hot.groupBy(key).agg(F.max("copies").alias("copies")))
    shard = F.xxhash64(spread_by)
    salts = F.when(F.col(key).isNull(), F.lit(FAN_OUT)).otherwise(F.coalesce("copies", F.lit(1)))
    spread = left.join(flag, key, "left").withColumn("salt", F.pmod(shard, salts).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)
    lookup = right.join(flag, key, "left").withColumn("salt", F.explode(every))
    return spread.drop("copies").join(lookup.drop("copies"), [key, "salt"], how).drop("salt")
