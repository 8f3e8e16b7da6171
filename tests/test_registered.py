"""Every registered query with SQL, side by side on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import difference, sql_connection

FOLDER = "/root/testdata/sf0.001"
# The smallest tables have no customer without a signal.
LARGER = {"cold_customers": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def con():
    return sql_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    folder = LARGER.get(name, FOLDER)
    assert difference(spark, con if folder == FOLDER else sql_connection(folder), name, folder) is None


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, con):
    recs = entry.entry(spark)
    assert recs.columns == ["customer_id", "item_id", "rnk", "score"]
    targets = con.execute(f"SELECT count(*) FROM ({entry.oracle_sql()['targets_validate']})").fetchone()[0]
    assert targets > 20 and recs.count() == targets * 10
