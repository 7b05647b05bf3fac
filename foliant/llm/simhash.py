"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits. One
differing bit changes one count by one, so the Manhattan distance of two count vectors is
a lower bound of the Hamming distance of the fingerprints. A distance of at most two
touches at most two of any ``GROUPS`` groups of segments: vectors that close share a grid
cell in the counts of the other groups. Cells are joined, the Manhattan bound is tested,
and what remains is verified on the bits themselves. Only distinct fingerprints take part.

Pairs are formed in cells of up to ``CELL`` members. In a larger cell every fingerprint
names the 65 words within one bit of it instead; two fingerprints have such a word in
common exactly when they differ in at most two bits, so each links to the smallest that
names the same word. That is as exact, and grows with the members and not their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.components import components, dealt_anew
from foliant.llm.storage import written
from foliant.llm.tokens import slices

SEED = 42
MOST_BITS = 2
SEGMENTS = 32
#: Groups of segments; all pairs of groups are left out in turn.
GROUPS = 4
CELL = 128
LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned; zero for a text without words."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words; fewer words make one run, none make none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space of ASCII only
    if not words:
        return np.zeros(0, dtype="<u8")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of each row of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                found = np.array([fingerprint(t, shingle) for t in some.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(found.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, "doc_id long, fp long")


def counts_of(fp: str | Column) -> Column:
    """The bit counts of the segments of ``fp``, each written as that many low ones of its two bits.

    In this form the Manhattan distance of two count vectors is ``bit_count(a ^ b)``.
    """
    fp = F.col(fp) if isinstance(fp, str) else fp
    low = F.lit(LOW).cast("long")
    one, two = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return one.bitwiseOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))


def _masks() -> list[int]:
    """For each pair of groups, the bits of the segments of all other groups, as signed longs."""
    edges = [2 * (SEGMENTS * g // GROUPS) for g in range(GROUPS + 1)]
    group = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [(1 << 64) - 1 - sum(group[g] for g in out) for out in combinations(range(GROUPS), MOST_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that join all fingerprints of ``distinct(fp)`` at most two bits apart.

    Every row is a true link. In crowded cells a link may run over a third fingerprint that
    is as close, so the connected components, not the pairs, are complete.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks()])
    keys = distinct.select("fp", counts_of("fp").alias("counts")).select("fp", F.posexplode(masks).alias("grid", "mask"), "counts")
    keys = keys.select("fp", "grid", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"))
    sizes = written(keys.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-cells")
    live = written(keys.join(sizes, ["grid", "cell"]), "simhash-live")

    members = live.where(F.col("n") <= CELL).groupBy("grid", "cell").agg(F.collect_list("fp").alias("fps"))

    def close(x: Column) -> Column:
        def test(y: Column) -> Column:
            bound = F.bit_count(counts_of(x).bitwiseXOR(counts_of(y))) <= MOST_BITS
            return (y > x) & bound & (F.bit_count(x.bitwiseXOR(y)) <= MOST_BITS)

        return F.transform(F.filter("fps", test), lambda y: F.struct(x.alias("a"), y.alias("b")))

    pairs = members.select(F.explode(F.flatten(F.transform("fps", close))).alias("p")).select("p.a", "p.b")

    crowded = live.where(F.col("n") > CELL).select("fp").distinct()
    near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = crowded.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("word"))
    shared = balls.groupBy("word").agg(F.min("fp").alias("first"), F.count("*").alias("n")).where("n > 1")
    over = balls.join(shared, "word").where("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return pairs.union(over).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for ``prints(doc_id, fp)``: the smallest doc_id that links reach.

    A row with a null doc_id takes part and is never the smallest; a component of such rows
    alone has a null component_id.
    """
    prints = written(prints, "simhash")
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    roots = written(components(links(first.select("fp"))), "simhash-roots")
    linked = roots.join(first, roots["node"] == first["fp"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id")).select(dealt_anew("root").alias("root"), "component_id")
    linked = linked.join(least, "root").select(dealt_anew("fp").alias("fp"), "component_id", F.lit(True).alias("linked"))
    known = first.join(linked, "fp", "left").select(dealt_anew("fp").alias("fp"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    Null text counts as empty; texts without words have fingerprint zero and are linked like
    any other. Repeated rows come back as often. No rows: no rows. Other columns are not read.
    """
    found = classes(fingerprints(docs, shingle))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
