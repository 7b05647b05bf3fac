"""Benchmark contamination by latent semantic retrieval, then subsequence and answer checks.

Texts are read as words of letters and figures. The vocabulary is that of the benchmark:
other words weigh nothing in any comparison with it. Passages are blocks of ``BLOCK``
words and windows of two of them. Items are searched for in parts that a passage can hold,
``PART`` words each and half of that apart. Document frequencies and a sketch of the TF-IDF
matrix A of all blocks, A'A times ``RANK + OVER`` random directions, are summed over
partitions; within the range found, a small matrix gives the singular values and the best ``RANK``
right singular vectors: the latent space. Passages whose cosine to a part is ``COSINE`` or more and
that have enough of its telling words are candidates. A candidate is verified by the longest
common subsequence of the whole item and as many words around the passage as the item can
take there: ``EXACT`` of the item's words decide alone; from ``PARAPHRASE`` on the item's answer
words, its most telling third, must be there too.

Items are taken in order of their ids and texts, in blocks of about ``ITEMS`` parts; each block
is a query set against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.storage import free_name, written
from foliant.llm.sums import summed
from foliant.llm.tokens import forget, slices
from foliant.llm.wordhash import word_hashes

ITEMS = 2000
BLOCK = 32
PART = 2 * BLOCK
RANK, OVER, POWER = 128, 16, 1
COMMON = 0.005
COSINE = 0.25
TELLING = 0.4
EXACT, PARAPHRASE, ANSWERS = 0.8, 0.55, 0.75
MARGIN = 16
LEAST_TELLING = 8
#: Items of fewer words must be there whole, word after word.
SHORT = 8
WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
LEAKS = "array<struct<item_id:long,cosine:double,lcs:double,answers:double,word:int>>"


@dataclass
class Model:
    item_ids: list[int]
    items: list[np.ndarray]  # codes of each item's words
    vocabulary: np.ndarray  # sorted word hashes; code = place + 1
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by code; 0 is any other word
    space: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # weighted right singular vectors, by code
    singular: np.ndarray = field(default_factory=lambda: np.zeros(0))
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)

    def finish(self) -> None:
        """What the search needs besides, from weights and space."""
        parts = [(i, at, c[at : at + PART]) for i, c in enumerate(self.items) for at in part_starts(len(c))]
        self.part_item, self.part_at = [i for i, _, _ in parts], [at for _, at, _ in parts]
        telling = [np.unique(c[self.weight[c] > 0]) for _, _, c in parts]
        self.n_telling = np.array([max(1, len(t)) for t in telling])
        #: (part, telling word) as one number each, sorted
        self.has = np.concatenate([p * len(self.weight) + t.astype(np.int64) for p, t in enumerate(telling)] + [np.array([np.iinfo(np.int64).max])])
        self.answer_words = []
        self.masks = []
        for codes in self.items:
            t = np.unique(codes[self.weight[codes] > 0])
            self.answer_words.append({int(c) for c in t[np.argsort(-self.weight[t], kind="stable")][: max(3, len(t) // 3)]})
            masks: dict[int, int] = {}
            for k, c in enumerate(codes.tolist()):
                masks[c] = masks.get(c, 0) | 1 << k
            self.masks.append(masks)
        q = np.array([self.space[c].sum(0) for _, _, c in parts]).reshape(len(parts), -1)
        self.latent = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def part_starts(length: int) -> list[int]:
    """First words of an item's parts; the last part ends with the item."""
    return [*range(0, max(0, length - PART), PART // 2), max(0, length - PART)]


def around(length: int, at: int, start: int) -> tuple[int, int]:
    """Words of a text that may belong to an item of ``length`` words whose part ``at`` is met in the passage at ``start``."""
    margin = MARGIN + max(0, length - PART) // 2
    return max(0, start - at - margin), start + 2 * BLOCK + max(0, length - at - PART) + margin


def lcs(masks: dict[int, int], length: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time."""
    full = (1 << length) - 1
    v = full
    for c in sequence:
        m = masks.get(c)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def blocks_of(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of each word, text of each block) for texts of ``counts`` words, one after another."""
    n_blocks = -(-counts // BLOCK)
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(n_blocks) - n_blocks
    return start[text] + (np.arange(len(codes)) - first[text]) // BLOCK, np.repeat(np.arange(len(counts)), n_blocks)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _block_sums(rows: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(block):
        start = np.flatnonzero(np.diff(block, prepend=-1))
        out[block[start]] = np.add.reduceat(rows, start)
    return out


def search(model: Model, codes: np.ndarray, counts: np.ndarray) -> list[list[tuple]]:
    """For each text its leaks ``(item, cosine, lcs, answers, first word of the passage)``."""
    found: list[dict[int, tuple]] = [{} for _ in counts]
    if not len(codes) or not model.items:
        return [[] for _ in counts]
    block, text_of = blocks_of(codes, counts)
    kept = np.flatnonzero(model.weight[codes] > 0)
    word, at = codes[kept], block[kept]
    n = len(text_of)
    begin = np.cumsum(counts) - counts
    first_block = np.searchsorted(text_of, np.arange(len(counts)))
    spans = np.searchsorted(at, np.arange(n + 1))
    some_blocks = max(64, 4096 * ITEMS // max(ITEMS, len(model.part_item)))
    for lo in range(0, n, some_blocks):  # blocks; a passage is a block and the next of its text
        hi = min(n, lo + some_blocks)
        a, b = spans[lo], spans[min(n, hi + 1)]
        x = _block_sums(model.space[word[a:b]], at[a:b] - lo, min(n, hi + 1) - lo)
        joined = np.zeros(hi - lo, bool)
        joined[: min(n, hi + 1) - lo - 1] = text_of[lo : min(n, hi + 1) - 1] == text_of[lo + 1 : min(n, hi + 1)]
        p = x[: hi - lo].copy()
        p[joined] += x[1:][joined[: len(x) - 1]] if len(x) > 1 else 0
        cosine = _unit(p) @ model.latent.T
        np.maximum(cosine, _unit(x[: hi - lo]) @ model.latent.T, out=cosine)
        row, part = np.nonzero(cosine >= COSINE)
        if not len(row):
            continue
        # telling words of the part in the passage, each once
        stop = np.where(joined[row], spans[np.minimum(row + lo + 2, n)], spans[row + lo + 1])
        length = stop - spans[row + lo]
        pair = np.repeat(np.arange(len(row)), length)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(spans[row + lo], length)
        key = part[pair] * len(model.weight) + word[place].astype(np.int64)
        hit = model.has[np.searchsorted(model.has, key)] == key
        some = np.unique(np.stack((pair[hit], word[place[hit]].astype(np.int64))), axis=1)[0] if hit.any() else np.zeros(0, np.int64)
        enough = np.bincount(some, minlength=len(row)) >= TELLING * model.n_telling[part]
        for r, p in zip(row[enough].tolist(), part[enough].tolist()):
            t, i = int(text_of[r + lo]), model.part_item[p]
            if found[t].get(i, (0, 0, -1))[2] == 1:
                continue  # the whole item is found
            start = int(r + lo - first_block[t]) * BLOCK
            size = len(model.items[i])
            a, b = around(size, model.part_at[p], start)
            sequence = codes[begin[t] + a : begin[t] + min(int(counts[t]), b)].tolist()
            share = lcs(model.masks[i], size, sequence) / size
            if share < PARAPHRASE:
                continue
            held = set(sequence)
            answers = sum(c in held for c in model.answer_words[i]) / max(1, len(model.answer_words[i]))
            if size < SHORT:
                own = model.items[i].tolist()
                good = any(sequence[k : k + size] == own for k in range(len(sequence) - size + 1))
            else:
                good = share >= EXACT or answers >= ANSWERS
            if good and share > found[t].get(i, (0, 0, -1))[2]:
                found[t][i] = (model.item_ids[i], float(cosine[r, p]), share, answers, start)
    return [sorted(x.values()) for x in found]


def _words(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    forget()
    w = word_hashes(pc.utf8_lower(texts), only_letters=True)
    return model.codes(w.hash), np.diff(w.first)


def item_blocks(benchmark: DataFrame, size: int = ITEMS) -> Iterator[Model]:
    """The items of ``benchmark(item_id, text)``, about ``size`` parts at a time; those without words are left out."""
    held: list[tuple[int, str]] = []
    parts = 0

    def model() -> Model:
        w = word_hashes(pa.array([t.lower() for _, t in held]), only_letters=True)
        out = Model([i for i, _ in held], [], np.unique(w.hash))
        out.items = [out.codes(w.hash[a:b]) for a, b in zip(w.first, w.first[1:])]
        return out

    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n_words = sum(1 for _ in WORD.finditer(r["text"] or ""))
        if r["item_id"] is not None and n_words:
            held.append((r["item_id"], r["text"]))
            parts += len(part_starts(n_words))
        if parts >= size:
            yield model()
            held, parts = [], 0
    if held:
        yield model()


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, codes``: the vocabulary codes of each text's words as unsigned 32-bit bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("codes", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                codes, counts = _words(shared.value, some.column("text"))
                ends = 4 * np.cumsum(counts)
                data = codes.astype("<u4").tobytes()
                rows = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(rows, pa.binary())], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(read, "doc_id long, codes binary")


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of ``doc_id, codes`` in slices of about ``most`` words, with codes and counts."""
    for batch in batches:
        for some in slices(batch, "codes", 4 * most):
            rows = some.column("codes").to_pylist()
            yield some, np.frombuffer(b"".join(rows), "<u4"), np.array([len(r) // 4 for r in rows], dtype=np.int64)


def fit(codes: DataFrame, model: Model, rank: int = RANK) -> Model:
    """Weights from document frequencies and the latent space, over all blocks of ``codes``."""
    size = len(model.vocabulary) + 1

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size + 1)
        for _, c, counts in _batches(batches):
            block, text_of = blocks_of(c, counts)
            known = c > 0
            once = np.unique(block[known] * size + c[known])
            out[:size] += np.bincount(once % size, minlength=size)
            out[size] += len(text_of)
        return out

    total = summed(codes, frequencies, (size + 1,))
    df, n = total[:size], total[size]
    idf = np.maximum(np.log((1 + n) / (1 + df)), 1e-3)
    telling = df <= max(COMMON * n, 2)
    for c in (c[at : at + PART] for c in model.items for at in part_starts(len(c))):  # common words are told by the least common of them
        c = np.unique(c)
        if telling[c].sum() < LEAST_TELLING:
            telling[c[np.argsort(df[c], kind="stable")][:LEAST_TELLING]] = True
    model.weight = np.where(telling, idf, 0.0).astype(np.float32)
    model.weight[0] = 0
    basis = np.random.default_rng(23).normal(size=(size, min(rank + OVER, size))).astype(np.float32)
    for _ in range(POWER):
        basis = _power_step(codes, model, basis)
    values, turn = np.linalg.eigh(_small_matrix(codes, model, basis))  # ascending
    kept = np.flatnonzero(values > 1e-9 * max(values[-1], 1e-30))[::-1][:rank]
    model.singular = np.sqrt(values[kept])
    model.space = (model.weight[:, None] * (basis @ turn[:, kept])).astype(np.float32)
    model.finish()
    return model


def _rows_on(weight: np.ndarray, weighted: np.ndarray, c: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, block) of the words that weigh, the blocks' TF-IDF rows of length 1 times a basis, and the lengths before."""
    block, text_of = blocks_of(c, counts)
    kept = np.flatnonzero(weight[c] > 0)
    word, at = c[kept], block[kept]
    times, places = _term_counts(word, at, len(weight))
    norm = np.zeros(len(text_of), np.float32)
    np.add.at(norm, places[1], (weight[places[0]] * times) ** 2)
    norm = np.maximum(norm, 1e-12) ** 0.5
    return word, at, _block_sums(weighted[word], at, len(text_of)) / norm[:, None], norm


def _term_counts(word: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """How often each word stands in each block, and (word, block) of these."""
    key, times = np.unique(at.astype(np.int64) * size + word, return_counts=True)
    return times.astype(np.float32), (key % size, key // size)


def _small_matrix(codes: DataFrame, model: Model, basis: np.ndarray) -> np.ndarray:
    """(A basis)'(A basis): what the singular values and directions within the basis come from."""
    shared = codes.sparkSession.sparkContext.broadcast((model.weight, model.weight[:, None] * basis))

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weight, weighted = shared.value
        out = np.zeros((weighted.shape[1], weighted.shape[1]))
        for _, c, counts in _batches(batches):
            _, _, y, _ = _rows_on(weight, weighted, c, counts)
            out += y.T @ y
        return out

    return summed(codes, part, (basis.shape[1], basis.shape[1]))


def _power_step(codes: DataFrame, model: Model, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of A'A ``basis``; A: normalised TF-IDF rows of all blocks."""
    shared = codes.sparkSession.sparkContext.broadcast((model.weight, model.weight[:, None] * basis))

    def sketch(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weight, weighted = shared.value
        out = np.zeros(weighted.shape)
        for _, c, counts in _batches(batches):
            word, at, y, norm = _rows_on(weight, weighted, c, counts)
            if not len(word):
                continue
            y /= norm[:, None]
            order = np.argsort(word, kind="stable")
            start = np.flatnonzero(np.diff(word[order].astype(np.int64), prepend=-1))
            out[word[order][start]] += np.add.reduceat(y[at[order]], start) * weight[word[order][start]][:, None]
        return out

    q, _ = np.linalg.qr(summed(codes, sketch, basis.shape, "<f4").astype(np.float64))
    return q.astype(np.float32)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answers, word``: a row for each document and item it holds.

    Null and empty texts hold nothing; items that are null, without words or without an id are
    left out. Repeated documents and items come back as often. No documents or items: no rows.
    Other columns are not read.
    """
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answers double, word int")
    for model in item_blocks(benchmark):
        codes = written(encoded(docs, model), "contamination-codes")
        shared = docs.sparkSession.sparkContext.broadcast(fit(codes, model))
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answers", pa.float64()), ("word", pa.int32())])

        def read(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for some, c, counts in _batches(batches):
                rows = [(d, *x) for d, found in zip(some.column("doc_id").to_pylist(), search(shared.value, c, counts)) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

        out = out.unionByName(codes.mapInArrow(read, out.schema))
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``leaks``, an array of what ``leaks`` returns for each row; a column of that name is replaced, others are kept.

    Null and empty texts, and a benchmark without items: empty arrays. Repeated rows are alike.
    """
    out = docs.withColumn("leaks", F.array().cast(LEAKS))
    for model in item_blocks(benchmark):
        codes = written(encoded(docs, model), "contamination-codes")
        shared = docs.sparkSession.sparkContext.broadcast(fit(codes, model))

        out = out.withColumn("leaks", F.concat("leaks", _column(shared)(F.col("text").cast("string"))))
    return out


def _column(shared: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf(LEAKS)
    def column(text: pd.Series) -> pd.Series:
        rows: list[list[dict]] = []
        for i in range(0, len(text), 200):
            part = pa.array([t if isinstance(t, str) else "" for t in text.iloc[i : i + 200]], pa.string())
            found = search(shared.value, *_words(shared.value, part))
            rows += [[dict(zip(("item_id", "cosine", "lcs", "answers", "word"), x)) for x in f] for f in found]
        return pd.Series(rows)

    return column


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, all columns as they are.

    Null and empty texts stay; very long ones are read whole; repeated rows stay or go together.
    """
    own = free_name(docs, "leaks_given")
    named = docs.withColumnRenamed("leaks", own)
    return with_leaks(named, benchmark).where(F.size("leaks") == 0).drop("leaks").withColumnRenamed(own, "leaks")
