"""What the tasks of a barrier stage add up and agree on, through files of the shared folder.

Tasks of a barrier stage run at the same time. Each writes its part of an array, reads its own slice of all
the others' parts and adds it up; then all read what each found in its slice. Nothing passes the driver, and a
task reads as much as it writes, however many tasks there are. Files are removed as soon as everybody has read them.
"""

from __future__ import annotations

import os
import pickle
import time
from collections.abc import Sequence

import numpy as np
from pyspark import BarrierTaskContext, SparkContext
from pyspark.sql import SparkSession

PATIENCE = 1800.0  # seconds without a sign of another task


def mounted(folder: str) -> str | None:
    """The path of a folder that tasks reach as files; None for other stores."""
    scheme, mark, path = folder.partition(":")
    if not mark:
        return folder
    return "/" + path.lstrip("/") if scheme == "file" else None


def slots(spark: SparkSession) -> int:
    """How many tasks surely run at the same time: 1 where executors come and go."""
    sc: SparkContext = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    return max(1, sc.defaultParallelism // int(sc.getConf().get("spark.task.cpus", "1")))


class Exchange:
    """Between the tasks of this barrier stage; each attempt of the stage has names of its own."""

    def __init__(self, folder: str) -> None:
        context = BarrierTaskContext.get()
        everyone = context.allGather(str(context.taskAttemptId()))
        self.part, self.parts = context.partitionId(), len(everyone)
        self.folder = os.path.join(folder, everyone[0])
        os.makedirs(self.folder, exist_ok=True)
        self.step = 0

    def _name(self, kind: str, step: int, part: int) -> str:
        return os.path.join(self.folder, f"{kind}-{step}-{part}")

    def _write(self, kind: str, data: Sequence[bytes]) -> None:
        final = self._name(kind, self.step, self.part)
        with open(final + ".part", "wb") as file:
            for piece in data:
                file.write(piece)
        os.replace(final + ".part", final)  # a file that has its name is whole

    def _open(self, kind: str, part: int):
        until = time.monotonic() + PATIENCE
        while True:
            try:
                return open(self._name(kind, self.step, part), "rb")
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"no word from task {part} for {PATIENCE} s") from None
                time.sleep(0.001)

    def span(self, length: int) -> tuple[int, int]:
        """This task's slice of that many entries."""
        return length * self.part // self.parts, length * (self.part + 1) // self.parts

    def sums(self, arrays: Sequence[np.ndarray]) -> list[np.ndarray]:
        """This task's slice (of the first axis) of the sum of all tasks' arrays."""
        arrays = [np.ascontiguousarray(a) for a in arrays]
        self._write("sum", [a.data.cast("B") if a.size else b"" for a in arrays])
        spans = [self.span(len(a)) for a in arrays]
        out = [a[low:high].copy() for a, (low, high) in zip(arrays, spans)]
        for at in range(1, self.parts):
            with self._open("sum", (self.part + at) % self.parts) as file:
                start = 0
                for mine, whole, (low, high) in zip(out, arrays, spans):
                    if mine.size:
                        row = whole.nbytes // len(whole)
                        file.seek(start + low * row)
                        mine += np.fromfile(file, mine.dtype, mine.size).reshape(mine.shape)
                    start += whole.nbytes
        return out

    def everyones(self, found) -> list:
        """What each task has found, in the order of tasks; ends a step."""
        self._write("found", [pickle.dumps(found)])
        answers = []
        for part in range(self.parts):
            with self._open("found", part) as file:
                answers.append(pickle.load(file))
        # All have read the sums of this step, and what was found in the step before.
        for kind, step in (("sum", self.step), ("found", self.step - 1)):
            try:
                os.unlink(self._name(kind, step, self.part))
            except FileNotFoundError:
                pass
        self.step += 1
        return answers
