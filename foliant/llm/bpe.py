"""Byte-level BPE by the ranks of a public vocabulary: encoding and decoding.

A text is cut by the vocabulary's pattern; each cut that is no entry itself is merged pair by
pair, the lowest rank first and the leftmost of equals. A segment tree over the cut's byte
positions holds the pair that begins at each live position, so the next merge is read from the
root and costs three point updates, also in a cut of a million letters.

Cuts repeat, so a worker keeps the ids of those it has met, bounded by bytes; the cache decides
nothing about the result.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from foliant.llm.storage import free_name
from foliant.llm.tokens import BYTE_LEVEL, PLAIN, slices

#: Bytes that a worker's cache of cuts may take, what an entry takes beside its text, and the longest cut that is kept.
MOST_CACHED, ENTRY_BYTES, LONGEST_CACHED = 96 << 20, 200, 64
#: Bytes of ids that are decoded in one go.
MOST_DECODED = 4 << 20
#: Leaves from which a tree's nodes are packed numbers.
PACKED = 1 << 12


class Pairs:
    """The pairs of neighbouring live positions as a segment tree over ``(rank, position)`` in one number.

    The least number is the lowest rank, and the leftmost position among equals. Rank ``none``
    stands for no pair. Nodes of long cuts are packed.
    """

    def __init__(self, ranks: list[int], none: int) -> None:
        bits = (len(ranks) - 1).bit_length()
        self.bits, self.size, self.none = bits, 1 << bits, none
        values = [(r << bits) + i for i, r in enumerate(ranks)] + [none << bits] * ((1 << bits) - len(ranks))
        node = [0] * (1 << bits) + values
        for i in range((1 << bits) - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b
        self.node = array("q", node) if self.size > PACKED else node

    def first(self) -> int:
        """The position of the pair to merge, -1 if there is none."""
        least = self.node[1]
        return least & (self.size - 1) if least >> self.bits < self.none else -1

    def put(self, *changes: tuple[int, int]) -> int:
        """Set the ranks of the pairs that begin at positions, and return ``first()``."""
        node, size, bits = self.node, self.size, self.bits
        for position, rank in changes:
            i = position + size
            node[i] = value = (rank << bits) + position
            while i > 1:
                other = node[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if node[i] == value:
                    break
                node[i] = value
        least = node[1]
        return least & (size - 1) if least >> bits < self.none else -1


class Bpe:
    """Ranks of byte strings, ``base64 rank`` a line, and the pattern that cuts texts."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.parts = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.none = max(self.parts) + 1
        self.cuts = regex.compile(pattern).findall
        self.plain_cuts = re.compile(BYTE_LEVEL).findall
        self.cache: dict[str, bytes] = {}
        self.held = 0  # bytes, about

    def merged(self, cut: bytes) -> list[int]:
        """Ids of one cut."""
        if (whole := self.ranks.get(cut)) is not None:
            return [whole]
        n, longest, none, rank = len(cut), self.longest, self.none, self.ranks.get
        ends = list(range(1, n + 1))  # of the live part that begins at a position
        before = list(range(-1, n))  # the live position before it
        ranks = [rank(cut[i : i + 2], none) for i in range(n - 1)]
        ranks.append(none)
        tree = Pairs(ranks, none)
        put, i = tree.put, tree.first()
        while i >= 0:
            gone = ends[i]
            ends[i] = end = ends[gone]
            before[end] = i
            after = ends[end] if end < n else 0
            own = rank(cut[i:after], none) if after and after - i <= longest else none
            j = before[i]
            if j >= 0:
                i = put((gone, none), (i, own), (j, rank(cut[j:end], none) if end - j <= longest else none))
            else:
                i = put((gone, none), (i, own))
        out, i, ids = [], 0, self.ranks
        while i < n:
            out.append(ids[cut[i : ends[i]]])
            i = ends[i]
        return out

    def ids(self, cut: str) -> bytes:
        merged = self.merged(cut.encode())
        found = struct.pack(f"<{len(merged)}I", *merged)
        if len(cut) <= LONGEST_CACHED:
            if self.held > MOST_CACHED:
                self.cache.clear()
                self.held = 0
            self.cache[cut] = found
            self.held += ENTRY_BYTES + len(cut) + len(found)
        return found

    def encode(self, text: str) -> bytes:
        known = self.cache.get
        return b"".join([known(cut) or self.ids(cut) for cut in (self.cuts if PLAIN.search(text) else self.plain_cuts)(text)])

    def decode(self, ids: bytes) -> bytes:
        part, step = self.parts.__getitem__, MOST_DECODED
        return b"".join([b"".join(map(part, np.frombuffer(ids[i : i + step], "<u4").tolist())) for i in range(0, len(ids), step)])


@cache
def vocabulary(path: str, pattern: str) -> Bpe:
    """The worker's vocabulary; workers serve many tasks."""
    return Bpe(path, pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: each whole text as little-endian unsigned 32-bit token ids, without special tokens.

    ``ranks`` is the path of a rank file that every executor has, ``pattern`` cuts the texts; the
    ids are those of a byte-pair encoder that encodes each cut by itself. A null or an empty text has no
    ids (an empty value). Strings that spell special tokens are text like any other. Other columns,
    repeated rows and null ids stay; a column of the name ``ids`` is replaced. No rows: no rows.
    """
    return _with_bytes(docs, F.coalesce(F.col(text).cast("string"), F.lit("")), ids, lambda x: vocabulary(ranks, pattern).encode(x))


def decoded(tokens: DataFrame, ranks: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``tokens`` with ``data``: the bytes that each row's ids stand for; no ids or null: no bytes.

    An id that the vocabulary lacks is an error: such a table belongs to another vocabulary. The bytes
    of a whole text's ids are its UTF-8 form; those of a part may begin inside a character.
    """
    return _with_bytes(tokens, F.coalesce(F.col(ids), F.lit(b"")), data, lambda x: vocabulary(ranks, pattern).decode(x))


def _with_bytes(rows: DataFrame, value, name: str, made) -> DataFrame:
    """``rows`` with the column ``name`` of ``made`` of each ``value``, a slice of a batch at a time."""
    given = free_name(rows, "value")
    kept = rows.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.BinaryType())])
    taken = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, given):
                out = pa.array([made(x) for x in some.column(given).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in taken), out], names=[*taken, name])

    return rows.withColumn(given, value).select(*taken, given).mapInArrow(run, schema)
