"""Queries with SQL, side by side; and the pipeline against its stages one by one."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from rebuy.llm import exact_dedup, near_join, quality
from rebuy.llm.common import words_of
from rebuy.llm.oracles import ORACLES
from rebuy.llm.queries import QUERIES
from rebuy.session import materialize
from tests.compare import difference, sql_connection
from tests.llm.helpers import shingles
from tests.llm.test_matching import brute_groups, brute_hits

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(spark, sql_connection(FOLDER), name, FOLDER) is None


def test_thirteen_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, against a plain version."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = materialize(stage(spark, kept, FOLDER), "test-stage")
        assert kept.columns == docs.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.count() == len(after) and set(after) <= set(before)
        rows = sorted(before.items())
        if name == "exact_dedup":
            groups = {}
            for i, t in rows:
                groups[t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t)] = i
            assert set(after) == set(groups.values())
        elif name == "ngram_jaccard_join":
            groups, _ = brute_groups(rows)
            assert set(after) == {i for (i, _), g in zip(rows, groups) if i == g}
        elif name == "benchmark_decontamination":
            assert set(after) == {i for i, t in rows if not ((h := brute_hits(t, items))[1] and 20 * h[1] >= h[0])}
        else:
            assert 0.7 * len(before) <= len(after) < len(before)
    packed = corpus_pipeline.packing(spark, kept, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(after.keys())


def test_run_returns_the_last_stage(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() > 0


def test_workers_need_no_package(tmp_path):
    """All queries where only the driver finds this package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from rebuy.llm.queries import QUERIES
from rebuy.session import local_session
spark = local_session("4", partitions=4)
def found(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"n": [int(importlib.util.find_spec("reb" + "uy") is not None)]}})
assert spark.range(1).mapInArrow(found, "n long").first().n == 0
for name, query in QUERIES.items():
    assert query(spark, {FOLDER!r}).count() > 0, name
"""
    (tmp_path / "run.py").write_text(code)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, check=True, timeout=900)
