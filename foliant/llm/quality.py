"""A quality classifier: ridge regression on random Fourier features, then isotonic calibration.

A text becomes a vector of statistics (lengths, repetition, character classes). Random
Fourier features of the standardised vector approximate a Gaussian kernel. Partitions sum
their part of the normal equations of a ridge fit; the sums, of fixed size, are solved on
the driver. An isotonic fit on labelled rows that the ridge has not seen turns its output
into a probability. Only the text is an input of a score.

The fit uses at most ``SAMPLE`` labelled rows, chosen by a hash of their ids.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.storage import delete, written
from foliant.llm.sums import summed
from foliant.llm.tokens import forget

#: Bound of the labelled rows that a model is fitted on.
SAMPLE = 60_000
FEATURES = 512
RIDGE = 1.0
THRESHOLD = 0.7
PARTS = 16
#: Share of the raw output in a score, which orders texts of one step of the calibration.
WITHIN_STEP = 1e-3

CLASSES = [
    b"|*#$%&@~^<>{}[]\\/=+_", b"!?", bytes(range(65, 91)), b"0123456789", b".,;:", b"\n", bytes(range(128, 256)), b" \t", b"\"'()-",
]
OF_CLASS = np.zeros((256, len(CLASSES)))
for _k, _c in enumerate(CLASSES):
    OF_CLASS[list(_c), _k] = 1
N_STATISTICS = len(CLASSES) + 9


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; a text without words has zeros for ratios of words."""
    text = text or ""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    shares = np.bincount(data, minlength=256) @ OF_CLASS / max(1, len(data))
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if n:
        counts = Counter(words)
        distinct, top = len(counts), max(counts.values())
        repeats = sum(map(eq, words, words[1:]))
        word = [(len(text) - n) / n, distinct / n, distinct / n**0.9, repeats / n, top / n, max(map(len, counts))]
    else:
        word = [0.0] * 6
    word[5] = np.log1p(word[5])
    return np.concatenate((shares, word, [np.log1p(len(text)), np.log1p(n), len(set(lines)) / len(lines)]))


def matrix(texts: list[str | None]) -> np.ndarray:
    forget()
    return np.array([statistics(t) for t in texts]).reshape(len(texts), N_STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # None: no labels of both kinds, every text gets ``prior``
    prior: float
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    @staticmethod
    def directions() -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20240501)
        width = 0.8 * N_STATISTICS**0.5
        return rng.normal(0, 1 / width, (N_STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def fourier(self, x: np.ndarray) -> np.ndarray:
        w, b = self.directions()
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ w + b
        return np.hstack([np.cos(z) * (2 / FEATURES) ** 0.5, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        raw = self.raw(matrix(texts))
        step = np.interp(raw, *self.steps)
        return np.clip((1 - WITHIN_STEP) * step + WITHIN_STEP / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)

    def column(self, text: str | Column) -> Column:
        """The score as a column."""

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                found = [self.score([t if isinstance(t, str) else None for t in texts.iloc[i : i + 500]]) for i in range(0, len(texts), 500)]
                yield pd.Series(np.concatenate(found) if found else np.zeros(0))

        return score(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit of ``label`` on ``raw`` by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of raw
    for x, y in zip(raw[order], label[order]):
        blocks.append([y, 1.0, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    y, n, x = np.array(blocks).T
    return x / n, y / n


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, <label>)`` of 0 and 1.

    Label rows with a null, and labels of absent documents, take no part. Without rows of
    both labels the model gives every text the share of label 1, with one row of each added.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.round(F.avg("label")).alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    schema = pa.schema([("half", pa.int32()), ("label", pa.float64()), ("x", pa.list_(pa.float64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("half"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # about `sample` rows at most
    half = F.when(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) == 0, 1).otherwise(0)
    rows = written(texts.select(half.alias("half"), "label", "text").mapInArrow(read, "half int, label double, x array<double>"), "quality-rows")

    found = rows.groupBy("half").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    n, ones = sum(r["n"] for r in found), sum(r["ones"] for r in found)
    if len(found) < 2 or not 0 < ones < n:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), None, (ones + 1) / (n + 2))
    moments = rows.where("half = 0").agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(N_STATISTICS)]).first()
    mean, scale = np.array(moments[:N_STATISTICS]), np.array(moments[N_STATISTICS:])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), None, (ones + 1) / (n + 2))

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.fourier(np.array(batch.column("x").to_pylist()))
                total += z.T @ np.hstack([z, batch.column("label").to_numpy()[:, None]])
        return total

    total = summed(rows.where("half = 0").repartition(PARTS), sums, (FEATURES + 1, FEATURES + 2))
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    rest = rows.where("half = 1").toPandas()  # at most `sample` rows
    model.steps = isotonic(model.raw(np.array(rest["x"].to_list())), rest["label"].to_numpy())
    delete(rows)
    return model


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``quality_score`` and ``quality_predicted`` (1 from ``threshold`` on).

    Null text counts as empty; empty texts are scored as any other. All columns are kept;
    columns of these two names are replaced.
    """
    scored = docs.withColumn("quality_score", model.column("text"))
    return scored.withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Label rows that a model may learn from: crc32 of the id's text modulo 4 is not 2."""
    return labels.where(~held_out("doc_id"))


def held_out(doc_id: str) -> Column:
    """Whether a document is kept for evaluation; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
