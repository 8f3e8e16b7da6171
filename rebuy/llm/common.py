"""Helpers shared by the operators: scans, ASCII folding, words, sorted lookups, worker state."""

from __future__ import annotations

import os
import string
import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebuy.session import shared_dir

# Word rule of the contracts: after lower-casing A-Z, a word is a run of digits, a-z and code
# points from U+0080 on. In UTF-8 all bytes of such code points are 0x80 or more, so the rule
# can be applied to bytes: everything else becomes a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


BATCH_BYTES = 8 << 20  # of rows that Spark hands to Python at once; both sides hold a batch as a whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the size up to which Spark fills a batch for Python; a smaller one that is set stays."""
    known, conf = spark._jvm.org.apache.spark.sql.internal.SQLConf, spark._jsparkSession.sessionState().conf()
    entry = known.ARROW_EXECUTION_MAX_BYTES_PER_BATCH()
    if not 0 < conf.getConf(entry) <= BATCH_BYTES:
        spark.conf.set(entry.key(), str(BATCH_BYTES))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; a null text has none. Unpaired surrogates cannot occur in Parquet strings."""
    return text.encode().translate(FOLD).split() if text else []


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Plain ``lower`` is the same, and faster, where all characters are ASCII."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def crc32_bucket(ids: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(F.encode(ids.cast("string"), "UTF-8")), F.lit(modulus)).cast("int")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return os.path.join(shared_dir(spark), "rebuy", f"{name}-{uuid.uuid4().hex}")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(rows: DataFrame, limit: int, *key: str) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of ``key``; all rows if there are no more."""
    total = rows.count()
    if total <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.lit(int(limit / total * (1 << 30))))


def count_not_above(bounds: Column, value: Column, step: int) -> Column:
    """How many entries of the ascending array ``bounds`` are at most ``value``.

    Looks at every ``step``-th entry first and then inside one stretch, so a
    long array costs about two square roots of its length per row.
    """
    size = F.size(bounds)
    marks = F.when(size >= step, F.sequence(F.lit(step), size, F.lit(step))).otherwise(F.array().cast("array<int>"))
    whole = F.size(F.filter(marks, lambda i: F.get(bounds, i - 1) <= value))
    rest = F.size(F.filter(F.slice(bounds, whole * step + 1, F.lit(step)), lambda x: x <= value))
    return whole * step + rest


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps for as long as it lives.

    Task functions travel by value, so their module globals are new in every
    task; caches and loaded vocabularies are kept in a module of the worker.
    """
    store = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def worker_memo(name: str, make: Callable[[], Any]) -> Any:
    """Like :func:`worker_state`, for what grows with the data: a worker keeps the last one it was asked for.

    Workers go from the tasks of one operator to those of the next; what the one before remembered is given back.
    """
    held = worker_state("memo", dict)
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


class Memo(dict):
    """A dict that computes missing entries and holds ``limit`` of them at most.

    When half of them are new, the other half is forgotten; entries that are
    still in use are taken over.
    """

    def __init__(self, compute: Callable[[Any], Any], limit: int):
        super().__init__()
        self.compute, self.limit, self.before = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit // 2:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value
