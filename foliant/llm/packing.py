"""Best-fit decreasing packing of token sequences into fixed-size training sequences.

Pieces of one length are interchangeable, so what best-fit decreasing does depends only
on how many pieces there are of each length. The packing is therefore decided on a
histogram of at most ``capacity`` lengths: lengths are taken in decreasing order, a
segment tree over remaining capacities finds the tightest open bin in logarithmic time,
and equal pieces that would follow each other into equal bins are placed as one run. The
runs (a few for each length, however many documents there are) are broadcast; each piece
finds its place from its length and its number among the pieces of that length. That
number comes from counts for each part of the token table, so token ids are never
shuffled while the counts for all parts are small, and once otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T, Window

from foliant.llm.storage import written
from foliant.llm.tokens import encoder, slices, tidy

CAPACITY = 1024
END_ID = 2
#: Counts are broadcast up to so many (part, length) pairs, and joined by a shuffle beyond.
MOST_BROADCAST = 400_000

TOKENS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("ids", T.BinaryType()),
])
ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())])


class CapacityTree:
    """Segment tree over remaining capacities that have open bins."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += change
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more that has an open bin."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.open[2 * i])
                return i - self.size
            i >>= 1
        return None


@dataclass
class Run:
    """Pieces ``first`` onwards of ``length``: ``each`` to a bin from ``bin`` on, the first of a bin at ``offset``."""

    length: int
    first: int
    bin: int
    each: int
    offset: int


@dataclass
class Plan:
    capacity: int
    runs: list[Run] = field(default_factory=list)
    bins: int = 0


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing on ``counts`` (pieces by length, lengths from 1 to ``capacity``)."""
    plan, tree = Plan(capacity), CapacityTree(capacity)
    bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs of (first bin, bins)

    def opened(left: int, first: int, n: int) -> None:
        if left and n:
            bins.setdefault(left, []).append((first, n))
            tree.add(left, 1)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            left = tree.tightest(length)
            if left is None:
                left, first = capacity, plan.bins
                each = left // length
                n = math.ceil((total - done) / each)
                plan.bins += n
            else:
                first, n = bins[left].pop()
                tree.add(left, -1)
                each = left // length
            plan.runs.append(Run(length, done, first, each, capacity - left))
            full, more = divmod(min(total - done, n * each), each)
            opened(left - each * length, first, full)
            if more:
                opened(left - more * length, first + full, 1)
            opened(left, first + full + (more > 0), n - full - (more > 0))
            done += full * each + more
    return plan


def cut_into_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: ``part, doc_id, piece, start, length, nth, ids``.

    ``part`` is the task and ``nth`` the piece's number among those of its length there.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for some in slices(batch, "text"):
                rows: list[tuple] = []
                for doc, ids in zip(some.column("doc_id").to_pylist(), code.batch(some.column("text").to_pylist(), end_id)):
                    for piece, (start, length) in enumerate(cut_into_pieces(len(ids) // 4, capacity)):
                        rows.append((part, doc, piece, start, length, int(seen[length]), ids[4 * start : 4 * (start + length)]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), ARROW)], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, TOKENS)


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pack the texts of ``docs(doc_id, text)`` into sequences of at most ``capacity`` ids.

    Returns ``doc_id, piece, start, length, ids, sequence_id, offset`` (ids: little-endian
    unsigned 32-bit). A text is its ids and then ``end_id``; only one that is longer than
    ``capacity`` is cut, into full pieces and a first piece of the rest. Null or empty
    text: one piece that holds the end id alone. Null and repeated ``doc_id``: each row is
    packed for itself. No rows in, no rows out. Other columns of ``docs`` are not read.
    """
    tokens = written(tokenize(docs, tokenizer, end_id, capacity), "tokens")
    counts = written(tokens.groupBy("part", "length").agg(F.count("*").alias("n")), "token-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    bases = bases.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases"))  # at most `capacity` entries
    if counts.count() <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").withColumn("nth", F.col("nth") + F.col("bases")[F.col("length")])

    by_length: dict[int, list[tuple]] = {}
    for r in plan_best_fit(totals, capacity).runs:
        by_length.setdefault(r.length, []).append((r.first, r.bin, r.each, r.offset))
    runs = docs.sparkSession.createDataFrame(list(by_length.items()), "length long, runs array<struct<first:long,bin:long,each:long,offset:long>>")
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("nth")), -1)
    placed = placed.join(F.broadcast(runs), "length").withColumn("run", run).withColumn("nth", F.col("nth") - F.col("run.first"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids",
        (F.col("run.bin") + F.floor(F.col("nth") / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.offset") + F.col("nth") % F.col("run.each") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids``, at most the capacity of ids each."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))
