"""Near-duplicate texts by wide SimHash fingerprints and a grid over segment bit counts.

The operator of ``simhash`` links fingerprints of 64 bits that differ in at most two; texts
of similarity 0.8 differ in far more. Here a text's distinct five-word shingles are summed
with random signs into ``BITS`` counters, and a Hadamard transform turns the counters to as
many random projections: their signs are the fingerprint. The share of differing bits of
two texts is the angle between them over pi, which for equal sizes follows from the Jaccard
similarity, so a bound of the similarity is a bound of the Hamming distance.

Fingerprints are cut into ``BANDS`` bands of ``SEGMENTS`` segments of two bits. Texts meet
where all bit counts of a band agree (a cell of the grid). There the Manhattan distance of
the bit counts of ``CHECK`` other words is tested as a lower bound, then their Hamming
distance; rows that are near a row of another component are joined to whole fingerprints.
Crowded cells are dealt to pairs of chunks, and a chunk pair returns marked rows and then a
forest of the closest links between components, never all pairs. Bands are taken in rounds:
links that are surely near enough join components, and later rounds compare only rows of
different ones.

Fingerprints only propose. Each link of a forest is then decided by the exact Jaccard
similarity of the two texts' sets of shingles, and classes are the components of the links that
pass. Equal fingerprints are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.components import components, dealt_anew
from foliant.llm.filters import filter_of, may_hold
from foliant.llm.storage import delete, free_name, written
from foliant.llm.tokens import forget, slices
from foliant.llm.wordhash import mix, shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BITS, SEGMENTS, BANDS = 2048, 11, 90
#: Words of 64 bits that go along with a row to its cells.
CHECK = 4
CHUNK = 2048
#: Bands at which rounds end; a round compares only what those before left apart.
ROUNDS = [12, BANDS]
#: Standard deviations that a candidate may lie beyond the bound, and that a sure link lies within.
SLACK, SURE = 3, -1
#: Crowded cells are broadcast up to so many, and joined by a shuffle beyond.
MOST_BROADCAST = 200_000
SIGNS = np.random.default_rng(41).choice(np.array([-1.0, 1.0], np.float32), BITS)

#: Which bits make up the bands; the first ones are kept for the test in a cell.
IN_BANDS = 64 * CHECK + np.arange(BITS - 64 * CHECK)[np.random.default_rng(43).permutation(BITS - 64 * CHECK)]
#: Segments that each band takes; a segment is of several bands where there are fewer of them than places.
BAND_SEGMENTS = np.array([np.random.default_rng(1000 + b).choice((BITS - 64 * CHECK) // 2, SEGMENTS, replace=False) for b in range(BANDS)])


def most_bits(similarity: float, bits: int, slack: float) -> int:
    """Differing bits to expect of ``bits`` at this Jaccard similarity, and ``slack`` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * (bits * p * (1 - p)) ** 0.5)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted; fewer words make one shingle, null counts as empty."""
    words = word_hashes(texts)
    counts = np.diff(words.first)
    runs = shingles(words.hash, shingle)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(np.arange(len(text)) + shingle <= words.first[text + 1]) if len(text) else np.zeros(0, np.int64)
    value, owner = runs[whole], text[whole]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        ones = np.array([np.bitwise_xor.reduce(mix(words.hash[a:b] + np.arange(b - a, dtype=np.uint64), 3)) for a, b in zip(words.first[short], words.first[short + 1])], np.uint64)
        value, owner = np.concatenate((value, ones)), np.concatenate((owner, short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], value[fresh]


def wide_fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A row of ``BITS / 8`` bytes for each text; texts without words have zeros, null counts as empty."""
    owner, value = shingle_sets(texts, shingle)
    n = len(texts)
    value = mix(value, 77)
    counter = (value >> np.uint64(20)).astype(np.int64) % BITS
    sign = np.where(value & np.uint64(1), 1.0, -1.0)
    out = np.zeros((n, BITS // 8), np.uint8)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        a, b = np.searchsorted(owner, (lo, hi))
        y = np.bincount((owner[a:b] - lo) * BITS + counter[a:b], weights=sign[a:b], minlength=(hi - lo) * BITS).astype(np.float32).reshape(-1, BITS)
        for _ in range(2):
            y = y * SIGNS
            h = 1
            while h < BITS:
                z = y.reshape(hi - lo, -1, 2, h)
                y = np.concatenate((z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]), axis=2).reshape(hi - lo, BITS)
                h *= 2
            y /= BITS**0.5
        out[lo:hi] = np.packbits(y > 1e-6, axis=1)
    return out


def cells_of(prints: np.ndarray, low: int = 0, high: int = BANDS) -> np.ndarray:
    """For each fingerprint the cells of the bands from ``low`` to ``high``: hashes of the bit counts of their segments."""
    bits = np.unpackbits(prints, axis=1)[:, IN_BANDS]
    counts = bits[:, ::2] + bits[:, 1::2]
    cell = np.zeros((len(prints), high - low), np.uint64)
    for k in range(SEGMENTS):
        cell = cell * np.uint64(3) + counts[:, BAND_SEGMENTS[low:high, k]]
    band = np.arange(low, high, dtype=np.uint64)
    return mix(cell * np.uint64(128) + band, 13) & ~np.uint64(127) | band


def _counts_form(x: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments of 64 bits, each as that many low ones."""
    low = np.uint64(0x5555555555555555)
    one, two = x & low, (x >> np.uint64(1)) & low
    return one | two | (one & two) << np.uint64(1)


def marked(key: np.ndarray, check: np.ndarray, root: np.ndarray, part: np.ndarray, cross: np.ndarray, most: int) -> np.ndarray:
    """Rows that a row of the same key (rows are sorted by it) and another root is within ``most`` bits of.

    ``check``: some words of each row's fingerprint; ``cross``: only rows of different parts are compared.
    """
    out = np.zeros(len(key), bool)
    form = _counts_form(check)
    at, step = np.arange(len(key) - 1), 1
    while len(at):
        at = at[key[at] == key[at + step]]
        near = at[root[at] != root[at + step]]
        near = near[~cross[near] | (part[near] != part[near + step])]
        near = near[np.bitwise_count(form[near] ^ form[near + step]).sum(axis=1) <= most]
        near = near[np.bitwise_count(check[near] ^ check[near + step]).sum(axis=1) <= most]
        out[near] = out[near + step] = True
        step += 1
        at = at[at + step < len(key)]
    return out


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start == 0 and held and not all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows(cell, root, ...)`` dealt to pairs of chunks ``cell, i, j`` of crowded cells, sorted by them.

    ``sizes``: ``cell, n, low, high``, which add up to the rows of each cell and its least and greatest
    root. Crowded cells of one root are left out: there is nothing to compare.
    """
    sizes = sizes.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("n") > CHUNK)
    crowded = written(sizes.select("cell", F.when(F.col("low") != F.col("high"), F.ceil(F.col("n") / CHUNK)).otherwise(0).cast("int").alias("chunks")), "wide-crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= MOST_BROADCAST else crowded
    rows = rows.join(crowded, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).where("chunks > 0")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("sig"), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "sig")


def _fingerprint_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _banded(rows: DataFrame, low: int, high: int) -> DataFrame:
    """``cell, sig, root, check`` for each row of ``rows(sig, root, fp)`` and band."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                fp = _fingerprint_rows(some.column("fp"))
                each = np.repeat(np.arange(len(fp)), high - low)
                check = pa.array([x.tobytes() for x in fp[:, : 8 * CHECK]], pa.binary())
                columns = [pa.array(cells_of(fp, low, high).view(np.int64).ravel()), *(c.take(pa.array(each)) for c in (some.column("sig"), some.column("root"), check))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "sig", "root", "check"])

    return rows.select("sig", "root", "fp").mapInArrow(read, "cell long, sig long, root long, check binary")


def _cell_sizes(rows: DataFrame, low: int, high: int) -> DataFrame:
    """``cell, n, low, high`` of the rows of ``_banded``, added up within batches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.concatenate([cells_of(_fingerprint_rows(batch.column("fp").slice(lo, 1000)), low, high) for lo in range(0, batch.num_rows, 1000)]).view(np.int64).ravel()
            root = np.repeat(batch.column("root").to_numpy(), high - low)
            order = np.argsort(cell, kind="stable")
            start = np.flatnonzero(np.diff(cell[order], prepend=~cell[order[0]]))
            n = np.diff(np.append(start, len(order)))
            columns = [cell[order[start]], n, np.minimum.reduceat(root[order], start), np.maximum.reduceat(root[order], start)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "n", "low", "high"])

    return rows.select("root", "fp").mapInArrow(read, "cell long, n long, low long, high long")


def _candidates(rows: DataFrame, low: int, high: int, similarity: float) -> DataFrame:
    """``a, b, x, y, bits``: forests of the closest links between roots ``x`` and ``y`` of ``rows(sig, root, fp)`` in cells of some bands."""
    most, far = most_bits(similarity, 64 * CHECK, SLACK), most_bits(similarity, BITS, SLACK)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, ["cell", "i", "j"]):
            cell, sig, root, part, i, j = (t.column(c).to_numpy() for c in ("cell", "sig", "root", "part", "i", "j"))
            check = np.frombuffer(b"".join(t.column("check").to_pylist()), np.uint64).reshape(-1, CHECK)
            with np.errstate(over="ignore"):
                key = mix(cell.view(np.uint64), 2) + mix(i.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64), 9)
            hit = marked(key, check, root, part, i != j, most)
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (cell, sig, root)], names=["cell", "sig", "root"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, ["cell", "i", "j"]):
            cell, sig, root, part, i, j = (t.column(c).to_numpy() for c in ("cell", "sig", "root", "part", "i", "j"))
            fp = _fingerprint_rows(t.column("fp")).view("<u8")
            edge = np.flatnonzero(np.diff(cell) | np.diff(i) | np.diff(j)) + 1
            a, b, bits = [], [], []
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(root)]):
                for x, y, n in forest(fp[lo:hi], root[lo:hi], part[lo:hi], i[lo] != j[lo], far):
                    a.append(lo + x)
                    b.append(lo + y)
                    bits.append(n)
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            swap = sig[a] > sig[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (sig[a], sig[b], root[a], root[b])), pa.array(bits, pa.int32())], names=["a", "b", "x", "y", "bits"])

    dealt = _dealt(_banded(rows, low, high), _cell_sizes(rows, low, high))
    met = written(dealt.mapInArrow(passing, "cell long, sig long, root long").distinct(), "wide-met")
    held = met.join(rows.select(dealt_anew("sig").alias("sig"), "fp"), "sig").select("cell", "sig", "root", "fp")
    sizes = met.select("cell", F.lit(1).alias("n"), F.col("root").alias("low"), F.col("root").alias("high"))
    found = written(_dealt(held, sizes).mapInArrow(linked, "a long, b long, x long, y long, bits int").distinct(), "wide-candidates")
    delete(met)
    return found


def forest(fp: np.ndarray, root: np.ndarray, part: np.ndarray, cross: bool, most: int) -> list[tuple[int, int, int]]:
    """``row, earlier row, bits``: of the pairs at most ``most`` bits apart, each row's closest to every component it joins.

    Rows of one root are joined from the start; ``cross``: only pairs of different parts.
    """
    top = np.unique(root, return_inverse=True)[1]
    out = []
    for x in range(1, len(fp)):
        may = np.flatnonzero((top[:x] != top[x]) & (part[:x] != part[x] if cross else True))
        bits = np.bitwise_count(fp[may] ^ fp[x]).sum(axis=1, dtype=np.int64)
        near = bits <= most
        may, bits = may[near], bits[near]
        if len(may):
            may, bits = may[order := np.argsort(bits, kind="stable")], bits[order]
            tops, first = np.unique(top[may], return_index=True)
            out += [(x, int(may[k]), int(bits[k])) for k in first]
            top[np.isin(top, tops)] = top[x]
    return out


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``row, hashes``: the shingle sets of the rows of ``docs(row, text)`` that are in ``wanted(row)``."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select(F.col("row").alias("key"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = may_hold(bits.value, batch.column("row").to_numpy())
            for some in slices(batch.take(pa.array(hit)), "text", 1 << 20) if len(hit) else ():
                owner, value = shingle_sets(some.column("text"), shingle)
                first = np.searchsorted(owner, np.arange(some.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.ListArray.from_arrays(pa.array(first), pa.array(value.view(np.int64)))], names=["row", "hashes"])

    return docs.mapInArrow(read, "row long, hashes array<long>").join(wanted, "row", "left_semi")


def _exact(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``links(a, b)`` whose ``sets(sig, hashes)`` have a Jaccard similarity of ``similarity`` or more."""
    a = sets.select(dealt_anew("sig").alias("a"), F.col("hashes").alias("of_a"))
    b = sets.select(dealt_anew("sig").alias("b"), F.col("hashes").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return links.join(a, "a").join(b, "b").where(both >= similarity * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def near_classes(docs: DataFrame, row: str, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``row, sig, root`` for each row of ``docs(<row>, text)``: rows of one root are near-duplicates.

    ``row`` must name the same row each time ``docs`` is read. Null and empty texts, and texts of
    white space, are one class; very long texts are read whole; repeated rows are one node. No
    rows: no rows.
    """
    schema = pa.schema([("row", pa.int64()), ("sig", pa.int64()), ("fp", pa.binary())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                fp = wide_fingerprints(some.column("text"), shingle)
                words = np.ascontiguousarray(fp).view("<u8")
                sig = np.zeros(len(fp), np.uint64)
                for k in range(words.shape[1]):
                    sig = mix(sig + words[:, k], 1)
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(sig.view(np.int64)), pa.array([x.tobytes() for x in fp], pa.binary())], schema=schema)

    texts = docs.select(F.col(row).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(prints, "row long, sig long, fp binary"), "wide-prints")
    distinct = written(rows.groupBy("sig").agg(F.min("fp").alias("fp"), F.min("row").alias("row")), "wide-distinct")
    sure = most_bits(similarity, BITS, SURE)
    roots, candidates = None, []
    for low, high in zip([0, *ROUNDS], ROUNDS):
        now = distinct.select("sig", F.col("sig").alias("root"), "fp")
        if roots is not None:
            now = written(distinct.select("sig", "fp").join(roots.select(dealt_anew("node").alias("sig"), "root"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "fp"), "wide-rooted")
        candidates.append(_candidates(now, low, high, similarity))
        near = candidates[0].where(F.col("bits") <= sure).select("a", "b")
        for c in candidates[1:]:
            near = near.union(c.where(F.col("bits") <= sure).select("a", "b"))
        roots = written(components(near), "wide-roots") if high < BANDS else None
    links = candidates[0].select("a", "b")
    for c in candidates[1:]:
        links = links.union(c.select("a", "b"))
    links = written(links.distinct(), "wide-links")
    ends = links.select(F.col("a").alias("sig")).union(links.select(F.col("b").alias("sig"))).distinct()
    shown = written(ends.join(distinct.select("sig", "row"), "sig"), "wide-shown")  # the row that shows each text
    sets = written(_sets(texts, shown.select("row"), shingle).join(shown, "row").select("sig", "hashes"), "wide-sets")
    exact = written(_exact(links, sets, similarity), "wide-exact")
    roots = written(components(exact), "wide-roots")
    delete(*candidates, links, shown, sets, exact, distinct)
    return rows.select("row", "sig").join(roots.select(dealt_anew("node").alias("sig"), "root"), "sig", "left").select("row", "sig", F.coalesce("root", "sig").alias("root"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the smallest ``doc_id`` (null last), then the first row.

    Links chain: a class is a connected component. All columns are kept, whatever their names. Rows
    are numbered once and written, as a reread could deal them out anew. Null, empty and
    very long texts, repeats and no rows: as in ``near_classes``.
    """
    own = free_name(docs, "row")
    numbered = written(docs.withColumn(own, F.monotonically_increasing_id()), "wide-numbered")
    found = written(near_classes(numbered.select(own, "text"), own, shingle, similarity), "wide-classes")
    ids = numbered.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    several = found.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select(dealt_anew("root").alias("root"))
    found = written(found.join(several, "root", "left_semi").join(ids, "row"), "wide-several")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = found.groupBy("root").agg(F.min(place)["row"].alias("first")).select(dealt_anew("root").alias("root"), "first")
    lost = found.join(first, "root").where("row != first").select(F.col("row").alias(own))
    return numbered.join(lost, own, "left_anti").drop(own)
