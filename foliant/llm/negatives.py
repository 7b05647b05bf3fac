"""Hard negatives of anchors by exact inner products, as products of blocks.

Anchors are dealt to blocks of a bounded size; a block is broadcast and meets every candidate in
matrix products, so what is emitted is a few rows for each anchor and task and never a pair.
Components are whole numbers: products in double precision are exact up to 2^53 and 64-bit integers take over
beyond. A first pass keeps each anchor's best rows of its own label (lists that merge), a second one
keeps, within the window of scores that each of those opens, the best of other labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from foliant.llm.storage import written

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 50, 95
SCALE = 256
#: Bytes of anchors that are broadcast at a time, and the rows of a product of blocks.
ANCHOR_BYTES, ANCHOR_ROWS, CANDIDATE_ROWS = 32 << 20, 512, 2048
FOUND = "anchor long, positive int, vec_id long, score long"
ARROW = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: The score of what does not count; its negative is a number too.
NONE = -(2**63 - 1)
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantized(table: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, label, x`` of the rows that take part: ``x`` holds ``floor(256 * component)`` as doubles."""
    e = F.col(embedding).cast("array<double>")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), e.alias("e")).where("vec_id is not null and label is not null and e is not null")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", F.transform("e", lambda x: F.floor(x * SCALE).cast("double")).alias("x"))


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``quantized`` rows.

    Positives of an anchor: its ``POSITIVES`` best other rows of the same label; for each the ``NEGATIVES`` best
    rows of other labels whose score is ``LEAST`` to ``MOST`` hundredths of its own; best first, ties to the smaller
    ``vec_id``. Rows of an anchor's ``vec_id`` are not others. A row that is repeated counts once. A shorter
    vector counts as padded with zeros. A positive whose window is empty has no row. Scores that 62
    bits may not hold are an error. No anchors: no rows.
    """
    spark = rows.sparkSession
    largest = F.aggregate("x", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    width, most, n = rows.agg(F.max(F.size("x")), F.max(largest), F.count(F.when(is_anchor, 1))).first()
    if not n:
        return spark.createDataFrame([], OUT)
    width, most = max(1, width), most or 0.0
    if most**2 * width >= 2**62:
        raise OverflowError("inner products do not fit 62 bits")
    kind = np.float64 if most**2 * width < 2**53 else np.int64
    passes = math.ceil(n * (8 * width + 128) / ANCHOR_BYTES)
    out = None
    for p in range(passes):
        some = rows.where(is_anchor).where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).distinct().toArrow()  # ANCHOR_BYTES, about
        found = written(_pass(rows, some, width, kind), "negatives")
        out = found if out is None else out.union(found)
    return out


def _pass(rows: DataFrame, anchors: pa.Table, width: int, kind: type) -> DataFrame:
    """The result for one block of anchors."""
    spark = rows.sparkSession
    ids, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
    n = len(ids)
    shared = spark.sparkContext.broadcast((ids, labels, _matrix(anchors.column("x").combine_chunks(), width, kind)))

    def alike(scores: np.ndarray, some: slice, own: np.ndarray, label: np.ndarray) -> Iterator[np.ndarray]:
        ids, labels, _ = shared.value
        yield np.where((labels[some, None] == label) & (ids[some, None] != own), scores, NONE)

    first = written(_best(rows.mapInArrow(_task(shared, width, kind, alike, 1, POSITIVES), FOUND), POSITIVES), "negatives-positives")
    listed = first.toArrow()  # at most POSITIVES rows for each anchor of the block
    least, most = np.full((POSITIVES, n), -NONE), np.full((POSITIVES, n), NONE)
    for anchor, rank, score in zip(*(listed.column(c).to_pylist() for c in ("anchor", "rank", "score"))):
        least[rank - 1, anchor], most[rank - 1, anchor] = -(-LEAST * score // 100), MOST * score // 100
    windows = spark.sparkContext.broadcast((least, most))

    def unlike(scores: np.ndarray, some: slice, own: np.ndarray, label: np.ndarray) -> Iterator[np.ndarray]:
        other = np.where(shared.value[1][some, None] != label, scores, NONE)
        for low, high in zip(*windows.value):
            yield np.where((other >= low[some, None]) & (other <= high[some, None]), other, NONE)

    second = _best(rows.mapInArrow(_task(shared, width, kind, unlike, POSITIVES, NEGATIVES), FOUND), NEGATIVES)
    second = second.select(F.col("anchor").alias("a"), (F.col("positive") + 1).alias("p"), F.col("rank").alias("nth"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    met = first.join(second, (F.col("anchor") == F.col("a")) & (F.col("rank") == F.col("p")))
    named = F.broadcast(spark.createDataFrame(pa.table({"number": np.arange(n), "anchor_id": ids})))  # the block's anchors
    return met.join(named, F.col("anchor") == F.col("number")).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("nth").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """``anchor, positive, rank, vec_id, score``: the ``k`` first of all tasks' lists; Spark cuts each list before the exchange."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()


def _matrix(x: pa.Array, width: int, kind: type) -> np.ndarray:
    sizes = np.diff(x.offsets.to_numpy())
    values = x.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width).astype(kind)
    out = np.zeros((len(x), width), kind)
    out[np.repeat(np.arange(len(x)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Lists:
    """The ``k`` best ``(score, vec_id)`` of each of ``n`` rows, best first."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), NONE)

    def add(self, some: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a block: ``scores`` of the rows ``some`` with candidates whose ``ids`` rise."""
        top = scores.max(axis=1)
        rows = np.flatnonzero((top > NONE) & (top >= self.score[some, -1]))
        if not len(rows):
            return
        block, every, k = scores[rows], np.arange(len(rows)), self.score.shape[1]
        score, id_ = [self.score[some][rows]], [self.id[some][rows]]
        for _ in range(min(k, block.shape[1])):
            best = block.argmax(axis=1)  # the first of equals
            score.append(block[every, best][:, None].astype(np.int64))
            id_.append(ids[best][:, None])
            block[every, best] = NONE
        score, id_ = np.concatenate(score, 1), np.concatenate(id_, 1)
        id_[score <= NONE] = NONE
        score, id_ = _sorted(score, id_)
        again = (score[:, 1:] == score[:, :-1]) & (id_[:, 1:] == id_[:, :-1])  # a row that stands in two blocks
        score[:, 1:][again] = NONE
        id_[:, 1:][again] = NONE
        score, id_ = _sorted(score, id_)
        self.score[some.start + rows], self.id[some.start + rows] = score[:, :k], id_[:, :k]


def _sorted(score: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((id_, -score), axis=1)
    return np.take_along_axis(score, order, 1), np.take_along_axis(id_, order, 1)


def _task(shared, width: int, kind: type, masked: Callable, lists: int, k: int) -> Callable:
    """Candidates of a task against all anchors of the block: the ``lists`` lists of ``k`` of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value[2]
        kept = [Lists(len(anchors), k) for _ in range(lists)]
        for batch in batches:
            for i in range(0, batch.num_rows, CANDIDATE_ROWS):
                part = batch.slice(i, CANDIDATE_ROWS)
                ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
                x = _matrix(part.column("x"), width, kind)
                order = np.argsort(ids, kind="stable")
                if len(np.unique(ids)) < len(ids):
                    _, order = np.unique(np.column_stack((ids, labels, x.astype(np.int64))), axis=0, return_index=True)
                ids, labels, x = ids[order], labels[order], x[order]
                for j in range(0, len(anchors), ANCHOR_ROWS):
                    some = slice(j, min(j + ANCHOR_ROWS, len(anchors)))
                    scores = (anchors[some] @ x.T).astype(np.int64)
                    for one, found in zip(kept, masked(scores, some, ids, labels)):
                        one.add(some, found, ids)
        for j, one in enumerate(kept):
            row, at = np.nonzero(one.score > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), j, np.int32)), pa.array(one.id[row, at]), pa.array(one.score[row, at])], schema=ARROW)

    return run
