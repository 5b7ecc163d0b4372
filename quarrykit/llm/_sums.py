"""Sums of equal-shaped arrays over all tasks, two Spark levels deep, so that no task or driver holds one per task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Groups at the first level.
FAN = 64


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]], kept: type = np.float64) -> dict[int, np.ndarray]:
    """{k: sum over tasks of the k-th array that ``partial`` returns for a task} (each of bounded size; sent as ``kept``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() % FAN
        arrays = [np.ascontiguousarray(a, kept).tobytes() for a in partial(batches)]
        n = len(arrays)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int32()), pa.array([group] * n, pa.int32()), pa.array(arrays, pa.binary())], ["slot", "part", "raw"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = None
        for raw in table.column("raw"):
            x = np.frombuffer(raw.as_buffer(), kept)
            total = x.astype(np.float64) if total is None else total + x
        return pa.table([table.column("slot").slice(0, 1), table.column("part").slice(0, 1), pa.array([total.astype(kept).tobytes()], pa.binary())], names=["slot", "part", "raw"])

    kind = "slot int, part int, raw binary"
    once = df.mapInArrow(run, kind).groupBy("slot", "part").applyInArrow(add, kind)
    rows = once.groupBy("slot").applyInArrow(add, kind).select("slot", "raw").collect()
    return {r["slot"]: np.frombuffer(r["raw"], kept).astype(np.float64) for r in rows}
