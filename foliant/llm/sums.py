"""Sums of arrays of one fixed shape over all partitions, by a tree of exchanges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.tokens import tidy

FAN = 8


def summed(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...], dtype: str = "<f8") -> np.ndarray:
    """The sum of ``part`` (an array of ``shape`` from a partition's batches) over the partitions of ``df``.

    Partial sums meet ``FAN`` at a time on executors until one is left for the driver.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(part(batches).astype(dtype))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            for x in batch.column("sum"):
                total += np.frombuffer(x.as_buffer(), dtype).reshape(shape)
        yield _row(total)

    n = max(1, df.rdd.getNumPartitions())
    out = df.mapInArrow(first, "sum binary")
    while n > 1:
        n = -(-n // FAN)
        out = out.repartition(n).mapInArrow(again, "sum binary")
    total = np.zeros(shape, dtype)
    for r in out.collect():  # one array
        total += np.frombuffer(r["sum"], dtype).reshape(shape)
    tidy()
    return total


def _row(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["sum"])
