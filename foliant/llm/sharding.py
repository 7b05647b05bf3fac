"""Sharding by histogram sort: exact byte counts below probes, refined to splitters, one exchange.

Documents are ordered by a key: the hash of the text, then ``doc_id`` (and, where a whole
group of equal texts and ids outgrows a shard's tolerance, the row's number). Probes cut the
key space into cells; every partition counts its bytes and rows in each cell, the sums are
exact. A splitter whose target lies near enough to a probe is settled; the cells that hold
the others are cut again. Counts are collected, never documents. Then one exchange moves
each document to its range, of which there are many for each shard so that no task takes a
whole shard; slots need no second pass, as the counts tell how many rows come before.

Equal texts are neighbours in this order. A splitter falls between groups of equal texts
wherever that meets the tolerance, and inside a group only where it does not.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, Window

from foliant.llm.storage import free_name, written

SHARDS = 40
#: Tolerance of a shard's edge, as a share of a shard, and of an inner edge, as a share of a range.
SHARD_TOLERANCE, RANGE_TOLERANCE = 0.001, 0.25
RANGES_PER_SHARD = 64
RANGE_BYTES = 256 << 20
LOW, HIGH = -(1 << 63), (1 << 63) - 1
ROW_BYTES = 16


def size_of(text: str | Column = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + ROW_BYTES


@dataclass
class Cell:
    """Keys between ``low`` and ``high`` (both included) and what lies before and in them."""

    low: tuple[int, ...]
    high: tuple[int, ...]
    bytes: int
    rows: int
    bytes_before: int
    rows_before: int

    def varies_at(self) -> int | None:
        """The first part of the key that varies; None if all keys are equal."""
        return next((i for i, (a, b) in enumerate(zip(self.low, self.high)) if a != b), None)


@dataclass
class Edge:
    """The first key of the upper side, and what lies below it."""

    key: tuple[int, ...]
    bytes_before: int
    rows_before: int


def _cell_number(part: Column, low: Column, width: Column) -> Column:
    """Number of the cell of ``part``: both may span the whole range of longs, so decimals."""
    wide = "decimal(20,0)"
    return F.floor((part.cast(wide) - low.cast(wide)) / width.cast(wide)).cast("int")


def _count(narrow: DataFrame, parts: list[str], cells: list[Cell], pieces: int) -> list[Cell]:
    """``cells``, each cut into at most ``pieces`` by the first part of the key that varies."""
    spark = narrow.sparkSession
    rows = []
    for i, c in enumerate(cells):
        at = c.varies_at()
        rows.append((i, at, c.low, c.high, max(1, -(-(c.high[at] - c.low[at] + 1) // pieces))))
    schema = "i int, at int, low array<long>, high array<long>, width decimal(20,0)"
    active = spark.createDataFrame([(i, at, list(lo), list(hi), Decimal(w)) for i, at, lo, hi, w in rows], schema)
    keys = F.array(*parts)
    if len(cells) == 1:
        longs = lambda k: F.array(*[F.lit(x).cast("long") for x in k])
        _, at, low, high, width = rows[0]
        joined = narrow.where((keys >= longs(low)) & (keys <= longs(high))).withColumns({"i": F.lit(0), "at": F.lit(at), "low": longs(low), "width": F.lit(Decimal(width))})
    else:
        first = narrow[parts[0]]
        joined = narrow.join(F.broadcast(active), (first >= F.col("low")[0]) & (first <= F.col("high")[0]) & (keys >= F.col("low")) & (keys <= F.col("high")))
    number = _cell_number(keys[F.col("at")], F.col("low")[F.col("at")], F.col("width"))
    found = joined.groupBy("i", number.alias("n")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(keys).alias("low"), F.max(keys).alias("high")).collect()
    out, by = [], {}
    for r in found:
        by.setdefault(r["i"], []).append(r)
    for i, c in enumerate(cells):
        b, n = c.bytes_before, c.rows_before
        for r in sorted(by.get(i, []), key=lambda r: r["n"]):
            out.append(Cell(tuple(r["low"]), tuple(r["high"]), r["bytes"], r["rows"], b, n))
            b, n = b + r["bytes"], n + r["rows"]
    return out


def splitters(narrow: DataFrame, parts: list[str], targets: list[tuple[float, float]], whole: Cell) -> tuple[list[Edge], bool]:
    """An edge for each (bytes below it, tolerance) of ascending ``targets``.

    The second result is False if equal keys keep some target from its tolerance.
    """
    edges: dict[int, Edge] = {}
    met = True
    pieces = max(1 << 14, 4 << len(targets).bit_length())
    active = {0: list(range(len(targets)))} if whole.varies_at() is not None else {}
    cells = [whole]
    for t in range(len(targets)) if not active else ():
        edges[t] = Edge(whole.low, 0, 0)
        met = met and whole.bytes <= targets[t][1]
    while active:
        now = [cells[i] for i in active]
        owners = list(active.values())
        cut = _count(narrow, parts, now, max(16, pieces // len(now)))
        cells, active = cut, {}
        starts = {c.bytes_before: i for i, c in enumerate(cut)}
        order = sorted(starts)
        for owned in owners:
            for t in owned:
                goal, tolerance = targets[t]
                i = starts[order[max(0, bisect.bisect_right(order, goal) - 1)]]
                c = cut[i]
                below, above = goal - c.bytes_before, c.bytes_before + c.bytes - goal
                if min(below, above) > tolerance and c.varies_at() is not None:
                    active.setdefault(i, []).append(t)
                    continue
                if min(below, above) > max(tolerance, c.bytes / max(1, c.rows)):
                    met = False
                if below <= above:
                    edges[t] = Edge(c.low, c.bytes_before, c.rows_before)
                else:
                    edges[t] = Edge((*c.high[:-1], c.high[-1] + 1) if c.high[-1] < HIGH else (c.high[0] + 1, *[LOW] * (len(parts) - 1)), c.bytes_before + c.bytes, c.rows_before + c.rows)
    return [edges[t] for t in range(len(targets))], met


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in a shard).

    Shards have nearly equal bytes: an edge between two lies within a thousandth of a shard,
    or one document, of its ideal place. Null text has the fixed 16 bytes alone; null ids come
    first in their group; repeated rows are dealt like others. No rows: no rows. With fewer
    rows than shards some shards are empty. Columns of the three names are replaced.
    """
    own = free_name(docs, "of_shards")
    while any(c.lower().startswith(own) for c in docs.columns):
        own = f"_{own}"
    out = _sharded(docs, shards, text, doc_id, own, numbered=False)
    if out is None:
        stored = written(docs.withColumn(f"{own}_row", F.monotonically_increasing_id()), "sharding")
        out = _sharded(stored, shards, text, doc_id, own, numbered=True).drop(f"{own}_row")
    return out


def _sharded(docs: DataFrame, shards: int, text: str, doc_id: str, own: str, numbered: bool) -> DataFrame | None:
    """``own``: what the names of columns begin with that are needed on the way."""
    key = {f"{own}_h": F.xxhash64(F.col(text).cast("string")), f"{own}_d": F.coalesce(F.col(doc_id).cast("long"), F.lit(LOW).cast("long"))}
    if numbered:
        key[f"{own}_r"] = F.col(f"{own}_row")
    parts = list(key)
    narrow = written(docs.select(size_of(text).alias("size"), *[c.alias(n) for n, c in key.items()]), "sharding-keys")
    keys = F.array(*parts)
    all_ = narrow.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(keys).alias("low"), F.max(keys).alias("high")).first()
    blank = docs.withColumns({"size": size_of(text), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    if not all_["rows"]:
        return blank
    total = all_["bytes"]
    each = max(RANGES_PER_SHARD, -(-total // (shards * RANGE_BYTES)))
    targets = []
    for j in range(1, shards * each):
        tolerance = total / shards * SHARD_TOLERANCE if j % each == 0 else total / shards / each * RANGE_TOLERANCE
        targets.append((total * j / (shards * each), tolerance))
    edges, met = splitters(narrow, parts, targets, Cell(tuple(all_["low"]), tuple(all_["high"]), total, all_["rows"], 0, 0))
    if not met and not numbered:
        return None
    # ranges between edges; an edge that is met twice bounds an empty range
    edges = [Edge((LOW,) * len(parts), 0, 0), *edges]
    for a, b in zip(edges, edges[1:]):
        if b.key < a.key:
            b.key, b.bytes_before, b.rows_before = a.key, a.bytes_before, a.rows_before
    bits = max(14, (2 * len(edges)).bit_length())
    bucket = lambda h: (h >> (64 - bits)) + (1 << bits - 1)
    inner: dict[int, list[tuple[int, ...]]] = {}
    for e in edges[1:]:
        inner.setdefault(bucket(e.key[0]), []).append(e.key)
    spark, rows, below = docs.sparkSession, [], 0
    for b in range(1 << bits):
        rows.append((b, below, [list(k) for k in inner.get(b, [])]))
        below += len(inner.get(b, []))
    b, below_, inner_, range_, base, place = (f"{own}_{x}" for x in ("b", "below", "inner", "range", "base", "place"))
    by_bucket = F.broadcast(spark.createDataFrame(rows, f"{b} int, {below_} int, {inner_} array<array<long>>"))  # bounded by the edges
    bases = F.broadcast(spark.createDataFrame([(j, j // each, e.rows_before - edges[j // each * each].rows_before) for j, e in enumerate(edges)], f"{range_} int, {own}_shard int, {base} long"))
    dealt = docs.withColumns(key | {"size": size_of(text)})
    dealt = dealt.withColumn(b, (F.shiftright(parts[0], 64 - bits) + (1 << bits - 1)).cast("int")).join(by_bucket, b)
    dealt = dealt.withColumn(range_, F.col(below_) + F.size(F.filter(inner_, lambda k: k <= keys))).drop(b, below_, inner_)
    nth = F.row_number().over(Window.partitionBy(range_).orderBy(*parts)) - 1
    dealt = dealt.withColumn(place, nth).join(bases, range_)
    return dealt.withColumns({"shard": F.col(f"{own}_shard"), "slot": F.col(base) + F.col(place)}).drop(range_, base, place, f"{own}_shard", *parts)
