"""Large frames: the tasks of a barrier stage train together."""

from __future__ import annotations

import os
from dataclasses import replace

import numpy as np
import pyarrow as pa

from rebuy.operators import boosting, features
from rebuy.operators.exchange import Exchange, mounted
from tests.test_boosting import SMALL, data  # noqa: F401


def test_tasks_of_a_large_frame_train_together(spark, data, monkeypatch):
    """One job trains several rounds of a frame that no task holds; the trees are those of a job per level and of a single task."""
    kind = type(data.train)
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    monkeypatch.setattr(boosting, "TOGETHER", 4)
    blocks = boosting.binned_blocks(data.train, features.FEATURES, 42)
    assert blocks.tasks > 2
    settings = [replace(SMALL, num_boost_round=n, num_leaves=leaves, bagging_fraction=b) for n, leaves, b in ((5, 7, 0.8), (3, 12, 1.0), (1, 7, 0.0))]
    expected = [[vars(t) for t in model] for model in boosting.boost(blocks, settings)]
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    jobs, collect = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: jobs.append(self) or collect(self))
    together = [[vars(t) for t in model] for model in boosting.boost(blocks, settings)]
    assert together == expected and len(expected[0]) == 5 and len(expected[0][0]["value"]) > 3
    assert len(jobs) <= 2  # one for each four rounds; a job per level needed more
    monkeypatch.setattr(boosting, "_meeting", lambda blocks: None)
    assert [[vars(t) for t in model] for model in boosting.boost(blocks, settings)] == expected


def test_tasks_add_up_through_files(spark, tmp_path):
    folder = str(tmp_path / "exchange")

    def work(batches):
        mine = sum(batch.num_rows for batch in batches)
        exchange, out = Exchange(folder), []
        for _ in range(3):
            wide, low = np.arange(10, dtype=np.int64)[:, None] * [mine, 1], exchange.span(10)[0]
            slices = exchange.everyones([(low, s.tolist()) for s in exchange.sums([wide, np.zeros((1, 4), np.int64)])])
            out.append([row for _, rows in sorted(s[0] for s in slices) for row in rows])
        yield pa.RecordBatch.from_arrays([pa.array([str(out)])], ["found"])

    rows = spark.range(0, 35, 1, 3).mapInArrow(work, "found string", barrier=True).collect()
    assert len(rows) == 3 and {r.found for r in rows} == {str([[[35 * i, 3 * i] for i in range(10)]] * 3)}
    left = [name for _, _, names in os.walk(folder) for name in names]
    assert len(left) == 3 and not any(name.startswith("sum") for name in left)


def test_only_files_and_lasting_executors_meet():
    assert mounted("/shared/x") == "/shared/x" and mounted("file:///shared/x") == "/shared/x" and mounted("file:/x") == "/x"
    assert mounted("hdfs://host/x") is None
