"""What follows the size of the input."""

from __future__ import annotations

from rebuy import session
from rebuy.sources.tables import read_shop_tables
from tests.test_fixtures import EV, ITEMS, TX


def test_more_input_makes_more_tasks(spark):
    """The number of partitions follows the size of the input; it is never lowered."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("12", "64MB")):
            spark.conf.set(name, value)
        session.spread_by_size(spark, 1000)
        assert spark.conf.get(names[0]) == "12" and spark.conf.get(names[1]) == str(session.MERGED_BYTES)
        session.spread_by_size(spark, 500 * session.INPUT_BYTES)
        assert spark.conf.get(names[0]) == "500"
        spark.conf.set(names[1], "1m")
        session.spread_by_size(spark, 1000)
        assert spark.conf.get(names[0]) == "500" and spark.conf.get(names[1]) == "1m"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_readers_tell_the_size_of_their_files(spark, tmp_path, monkeypatch):
    told = []
    monkeypatch.setattr("rebuy.sources.tables.spread_by_size", lambda spark, size: told.append(size))
    paths = [str(tmp_path / name) for name in ("tx", "ev", "items")]
    for schema, path in zip((TX, EV, ITEMS), paths):
        spark.createDataFrame([], schema).write.parquet(path)
    read_shop_tables(spark, *paths)
    assert told == [session.source_bytes(spark, *paths)] and told[0] > 0


def test_no_task_reads_more_than_a_bounded_size(spark, tmp_path):
    """More input makes more scanning tasks, not larger ones; a setting that is lower already stays."""
    name, path = "spark.sql.files.maxPartitionBytes", str(tmp_path / "lines")
    before = {key: spark.conf.get(key) for key in (name, "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    rows = spark.range(0, 12_000_000, 1, 2).selectExpr("id", "hash(id, 1) AS a", "hash(id, 2) AS b")
    rows.write.option("parquet.block.size", 2 << 20).option("compression", "none").parquet(path)
    try:
        spark.conf.set(name, "128MB")
        session.spread_by_size(spark, 1000)
        size = session.source_bytes(spark, path)
        tasks = spark.read.parquet(path).rdd.getNumPartitions()
        assert size > 12 * session.READ_BYTES and tasks >= size // session.READ_BYTES
        spark.conf.set(name, "1m")
        session.spread_by_size(spark, 1000)
        assert spark.conf.get(name) == "1m"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
