"""Session helpers: local sessions for tests, and tables that outlive a lost executor."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


T = TypeVar("T")


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rebuy")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settle(spark: SparkSession) -> None:
    """Turn off Spark 4.1's partitioning-aware union for this session, and have shuffle files removed when a job is over.

    That union takes a union of equally partitioned parts for partitioned itself and
    skips the shuffle before grouping. When a part is then replaced by a
    reused exchange, the rows of a key end up in several partitions and
    windows and sums over them come out wrong.

    Tables that a query stores on its way are read back from where they were written; what was shuffled
    to make them would otherwise stay on the executors' disks until the driver collects its garbage.
    A table that is asked for twice is computed again (its stages are retried).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


# Stored input that a shuffle deals out to one task, shuffled data that one task takes at most when Spark merges partitions,
# and stored input that one task reads at most (a row group of a file is never cut).
INPUT_BYTES = 4 << 20
MERGED_BYTES = 8 << 20
READ_BYTES = 8 << 20


def spread_by_size(spark: SparkSession, size: int) -> None:
    """Deal ``size`` bytes of input out to as many tasks as they need, so that more input makes more tasks, not larger ones.

    The number of shuffle partitions is only ever raised, and the sizes up to which adaptive execution merges
    them and scans are packed are only ever lowered; what is small is still merged. Scans count, as beyond 200
    partitions a task holds what it has read in memory while it deals it out.
    """
    wanted = -(-size // INPUT_BYTES)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    # The JVM knows all the ways to write a size.
    known, conf = spark._jvm.org.apache.spark.sql.internal.SQLConf, spark._jsparkSession.sessionState().conf()
    for entry, most in ((known.ADVISORY_PARTITION_SIZE_IN_BYTES(), MERGED_BYTES), (known.FILES_MAX_PARTITION_BYTES(), READ_BYTES)):
        if conf.getConf(entry) > most:
            spark.conf.set(entry.key(), str(most))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is missing and the
    master is local; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rebuy-checkpoint-"))
    return sc.getCheckpointDir()


PASSING = "rebuy.passing"  # local property: the folder of tables that are only needed for a while


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside, also by background threads begun there, are removed at the end.

    What is to last must be written (``lasting``) before that.
    """
    sc, before = spark.sparkContext, spark.sparkContext.getLocalProperty(PASSING)
    folder = os.path.join(shared_dir(spark), "rebuy", f"passing-{uuid.uuid4().hex}")
    sc.setLocalProperty(PASSING, folder)
    try:
        yield
    finally:
        sc.setLocalProperty(PASSING, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used for aggregates with several consumers: the lineage is cut, a lost
    executor costs no recomputation, and each consumer still prunes columns.
    """
    spark = df.sparkSession
    folder = None if lasting else spark.sparkContext.getLocalProperty(PASSING)
    path = os.path.join(folder or os.path.join(shared_dir(spark), "rebuy"), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Materialize independent tables at the same time, so that one fills the gaps of another."""
    jobs = {name: in_background(df.sparkSession, lambda df=df, name=name: materialize(df, name)) for name, df in frames.items()}
    return {name: job.result() for name, job in jobs.items()}


def in_background(spark: SparkSession, work: Callable[[], T]) -> Future[T]:
    """Start jobs from a second thread of the driver."""
    pool = ThreadPoolExecutor(1)
    job = pool.submit(inheritable_thread_target(spark)(work))
    pool.shutdown(wait=False)
    return job


def source_version(spark: SparkSession, *paths: str) -> str:
    """A name for what the paths hold now: it changes when files are added, replaced or removed."""
    parts = []
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        content = store.getContentSummary(path)
        parts.append(f"{name}@{store.getFileStatus(path).getModificationTime()}/{content.getLength()}/{content.getFileCount()}")
    return "|".join(parts)


def source_bytes(spark: SparkSession, *paths: str) -> int:
    """How much the paths hold now."""
    total = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def finished_folder(spark: SparkSession, path: str) -> str | None:
    """A finished table below ``path``."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "*", "_SUCCESS"))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return min((marker.getPath().getParent().toString() for marker in found or ()), default=None)


def kept_folder(spark: SparkSession, kind: str, key: str, folder: str | None = None) -> str:
    return os.path.join(folder or os.path.join(shared_dir(spark), "rebuy"), f"{kind}-{hashlib.sha256(key.encode()).hexdigest()[:32]}")


def kept(spark: SparkSession, kind: str, key: str, make: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The table of this kind and key in the shared folder (or ``folder``); it is made and written if it is not there.

    Each writer uses a new folder below the key's, and only finished folders are read, so
    no table that somebody reads is ever overwritten. An empty key stands for nothing in
    particular: such tables are not shared.
    """
    if not key:
        return materialize(make(), kind)
    path = kept_folder(spark, kind, key, folder)
    found = finished_folder(spark, path)
    if found is None:
        found = os.path.join(path, uuid.uuid4().hex)
        make().write.parquet(found)
    return spark.read.parquet(found)
