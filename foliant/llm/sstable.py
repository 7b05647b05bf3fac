"""Token ids in sorted-string-table files, one file for each range of document ids.

File format (integers little-endian):

    magic, data blocks, index, Bloom filter, footer

A block holds entries in ascending key order, compressed as one zstd frame. An entry is
varint(shared key bytes) varint(other key bytes) varint(value bytes), the other key bytes
and the value: a document's ids, ``width`` bytes each. The sparse index has a record for
each block: its first key, where it lies, its sizes, and how many documents and ids of
the file come before it. The footer (fixed size, at the end) says where index and filter
lie. A lookup reads the footer, asks the filter, binary-searches the index and reads one
block (more only where a key's entries go on).

A key is ten bytes: 0 for a null id or 1, a byte of zero, then the id as a big-endian
unsigned 64-bit integer with its sign bit turned, so that keys sort as ids do.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from foliant.llm.storage import drop_others, fresh_path, written
from foliant.llm.tokens import encoder, slices, tidy

MAGIC = b"FOLSST01"
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQQQ8s")
RECORD = struct.Struct("<10sQIIQQ")
END_ID = 1


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 10 if doc_id is None else b"\1\0" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[2:])[0] - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(keys: list[bytes], size: int) -> np.ndarray:
    """Bit numbers of each key in a filter of ``size`` bits, by double hashing."""
    x = np.frombuffer(b"".join(k[2:] for k in keys), dtype=">u8").astype(np.uint64) + np.array([k[0] for k in keys], dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = (x >> np.uint64(32)) | np.uint64(1)
        return (x[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(size)


class Writer:
    """Writes entries, given in ascending key order, to an open stream."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES) -> None:
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.docs = self.ids = self.held = 0
        self.block: list[bytes] = []
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.last = self.first = b""
        self.before = (0, 0)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        if not self.block:
            self.first, self.before, self.last = key, (self.docs, self.ids), b""
        value = ids
        if self.width == 2:
            numbers = np.frombuffer(ids, "<u4")
            if len(numbers) and numbers.max() > 0xFFFF:
                raise ValueError(f"id {numbers.max()} takes more than two bytes: write with width=4")
            value = numbers.astype("<u2").tobytes()
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), len(self.last))
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.held += len(entry)
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids) // 4
        if self.held >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            packed = pa.Codec("zstd", 1).compress(raw, asbytes=True)
            self.index.append(RECORD.pack(self.first, self.at, len(packed), len(raw), *self.before))
            self._put(packed)
            self.block, self.held = [], 0

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._put(b"".join(self.index))
        bloom_at, size = self.at, max(64, -(-BLOOM_BITS * len(self.keys) // 8) * 8)
        flags = np.zeros(size, dtype=bool)
        for i in range(0, len(self.keys), 50_000):
            flags[_bits(self.keys[i : i + 50_000], size).astype(np.int64)] = True
        self._put(np.packbits(flags, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, size, self.docs, self.ids, self.width, len(self.index), MAGIC))


class Reader:
    """Reads a file of this format from a random-access file."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        self.index_at, index_bytes, self.bloom_at, self.bloom_size, self.docs, self.ids, self.width, self.blocks, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token table")
        self.index = [RECORD.unpack(x) for x in _chunks(file.read_at(index_bytes, self.index_at), RECORD.size)]
        self.first_keys = [r[0] for r in self.index]
        self._bloom: np.ndarray | None = None

    def may_have(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            self._bloom = np.unpackbits(np.frombuffer(self.file.read_at(self.bloom_size // 8, self.bloom_at), np.uint8), bitorder="little")
        return bool(self._bloom[_bits([key_of(doc_id)], self.bloom_size).astype(np.int64)].all())

    def _block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, packed, raw, _, _ = self.index[n]
        data = pa.Codec("zstd").decompress(self.file.read_at(packed, at), raw, asbytes=True)
        i, key = 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            other, i = read_varint(data, i)
            value, i = read_varint(data, i)
            key = key[:shared] + data[i : i + other]
            yield key, data[i + other : i + other + value]
            i += other + value

    def _ids(self, value: bytes) -> bytes:
        return value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """Ids of every document with this identifier, in the order written."""
        key, found = key_of(doc_id), []
        if not self.index or not self.may_have(doc_id):
            return found
        n = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while n < len(self.index) and self.first_keys[n] <= key:
            found += [self._ids(v) for k, v in self._block(n) if k == key]
            n += 1
        return found

    def scan(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(identifier, ids of the file before it, ids) in the order written."""
        at = 0
        for n in range(len(self.index)):
            for key, value in self._block(n):
                ids = self._ids(value)
                yield id_of(key), at, ids
                at += len(ids) // 4


def _chunks(data: bytes, size: int) -> Iterator[bytes]:
    return (data[i : i + size] for i in range(0, len(data), size))


@dataclass
class Store:
    """A place in the file system that a URI names."""

    fs: pafs.FileSystem
    path: str

    @classmethod
    def of(cls, uri: str) -> Store:
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return cls(*pafs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri))

    def reader(self) -> Reader:
        return Reader(self.fs.open_input_file(self.path))


FILES = "shard int, path string, n_docs long, n_ids long"
FILES_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tables(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shards: int | None = None, width: int = 2) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write one file for each range of ``doc_id`` to ``folder``.

    Returns ``shard, path, n_docs, n_ids``, a row for each file; ids ascend over the shards
    and in them (null first; equal ids in the order of their texts' hashes). A file gets its
    name only when it is whole, so a task that is run again replaces it by the same. Null
    or empty text: the end id alone. No documents: no files. ``width`` is 2 or 4 bytes an id; an id
    that does not fit is an error. What failed tasks have left is deleted at the end.
    """
    n = shards or max(1, docs.rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        context, code = TaskContext.get(), encoder(tokenizer)
        shard = context.partitionId()
        place = Store.of(f"{folder}/shard-{shard:06d}.sst")
        draft = f"{place.path}.{context.taskAttemptId()}"
        out = writer = None
        for batch in batches:
            for some in slices(batch, "text"):
                if writer is None:
                    place.fs.create_dir(draft.rpartition("/")[0], recursive=True)
                    out = place.fs.open_output_stream(draft)
                    writer = Writer(out, width)
                for doc, ids in zip(some.column("doc_id").to_pylist(), code.batch(some.column("text").to_pylist(), end_id)):
                    writer.add(key_of(doc), ids)
        if writer is not None:
            writer.close()
            out.close()
            place.fs.move(draft, place.path)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, f"{folder}/shard-{shard:06d}.sst", writer.docs, writer.ids), FILES_ARROW)], schema=FILES_ARROW)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    files = written(dealt.mapInArrow(write, FILES), "sst-files")
    drop_others(docs.sparkSession, folder, ".sst")
    return files


ROWS = "shard int, doc_id long, start long, ids binary"
ROWS_ARROW = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read_tables(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document of ``files``; start: ids of all documents before it."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    number = F.row_number().over(Window.orderBy("shard")) - 1
    files = files.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"), number.alias("number"))
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                rows: list[tuple] = []
                size = 0
                for doc, start, ids in Store.of(file["path"]).reader().scan():
                    rows.append((file["shard"], doc, file["base"] + start, ids))
                    size += len(ids)
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return files.repartitionById(n, F.col("number")).mapInArrow(read, ROWS).drop("shard")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ROWS_ARROW)], schema=ROWS_ARROW)


def token_tables(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared store and read it back: ``doc_id, start, ids``."""
    folder = fresh_path(docs.sparkSession, "token-tables")
    return read_tables(write_tables(docs, tokenizer, folder, end_id))
