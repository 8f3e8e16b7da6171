"""Runs registered queries next to their SQL: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry
from rebuy.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sql_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, con, name: str, folder: str) -> str | None:
    """None if query and SQL agree, otherwise a short description."""
    found = entry.queries()[name](spark, folder)
    rows = rows_of(found.columns, found.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    wanted = rows_of(names, result.fetchall())
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} vs {sorted(names)}"
    if rows == wanted:
        return None if rows else "both empty"
    extra = sorted(set(rows) - set(wanted))[:3]
    missing = sorted(set(wanted) - set(rows))[:3]
    return f"{len(rows)} vs {len(wanted)} rows; extra {extra}; missing {missing}"


if __name__ == "__main__":
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    chosen = sys.argv[2:] or list(entry.queries())
    session = local_session("8")
    connection = sql_connection(folder)
    failed = 0
    for query in chosen:
        began = time.time()
        if query in entry.oracle_sql():
            problem = difference(session, connection, query, folder)
        else:
            problem = None if entry.queries()[query](session, folder).collect() else "no rows"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {query} {time.time() - began:.1f}s {problem or ''}", flush=True)
    sys.exit(1 if failed else 0)
