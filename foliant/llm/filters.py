"""Bloom filters of longs of a bounded size, built on executors in slices of bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.wordhash import mix

#: Bits for each member, and at most; a filter that is full merely lets more pass.
BITS_EACH, MOST_BITS = 16, 1 << 30
#: Bits of a slice, which one task fills.
SLICE = 1 << 25


def _places(x: np.ndarray, size: int) -> np.ndarray:
    return (mix(x.view(np.uint64), 5) % np.uint64(size)).astype(np.int64)


def filter_of(members: DataFrame) -> np.ndarray:
    """The filter of the longs ``members(key)``, as bytes; no members: an empty filter. It lets every member pass."""
    n = members.count()
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_EACH * n).bit_length()))
    slices = max(1, size // SLICE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column("key").to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array((at // SLICE).astype(np.int32)), pa.array(at % SLICE)], names=["slice", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            number, at = batch.column("slice").to_numpy(), batch.column("at").to_numpy()
            for k in np.unique(number).tolist():
                bits = held.setdefault(k, np.zeros(min(SLICE, size) // 8, np.uint8))
                own = at[number == k]
                np.bitwise_or.at(bits, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["slice", "bits"])

    placed = members.select("key").mapInArrow(place, "slice int, at long").repartition(slices, "slice")
    out = np.zeros(size // 8, np.uint8)
    for r in placed.mapInArrow(fill, "slice int, bits binary").toLocalIterator():
        first = r["slice"] * SLICE // 8
        out[first : first + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the ``keys`` that may be members of the filter ``held``."""
    at = _places(keys, 8 * len(held))
    return np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
