"""Sums of vectors over all tasks, added up as a tree so that neither a task nor the driver holds more than a few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Sums of so many tasks are added up in one.
FAN = 32


def added(df: DataFrame, fan: int = FAN) -> np.ndarray | None:
    """The sum of the first column's vectors (bytes of doubles); None where there are none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                x = np.frombuffer(v.as_buffer(), float)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    partitions = df.rdd.getNumPartitions()
    while partitions > 1:
        partitions = -(-partitions // fan)
        df = df.repartition(partitions).mapInArrow(add, "v binary")
    found = df.collect()
    return np.sum([np.frombuffer(r[0], float) for r in found], axis=0) if found else None
