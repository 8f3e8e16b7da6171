"""Ranked truncation, the shape most operators end in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuy.functions.scoring import ratio


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rnk") -> DataFrame:
    """First ``n`` rows per key.

    Spark cuts each map task to ``n`` rows per key before the shuffle, so a
    hot key sends at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_n_shares(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key by ``points``, with ``score`` = points / best points of the key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = top_n(df, keys, order, n)
    return kept.withColumn("score", F.least(ratio(F.col("points"), F.first("points").over(window)), F.lit(1.0)))


def head(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rnk") -> DataFrame:
    """Best ``n`` rows overall; the ranking window only ever sees those ``n`` rows."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))
