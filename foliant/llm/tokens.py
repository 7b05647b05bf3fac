"""Token ids of whole texts with a public tokenizer, as little-endian unsigned 32-bit bytes.

Most of the library's time goes into setting up an encoding for each text, so texts
of plain Latin characters are cut into the tokenizer's own pre-tokens first and the
library encodes each distinct pre-token once. A text with any other character goes to
the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import struct
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa

#: The pre-token patterns of the two public vocabularies, for the characters of PLAIN.
BYTE_LEVEL = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: ASCII without control characters other than white space, and the letters of Latin-1.
PLAIN = re.compile("[^\t\n\r\x20-\x7eÀ-ÿ]")
#: Bytes that a worker's cache of pre-tokens may take, what an entry takes beside its text, and the longest that is kept.
MOST_CACHED, ENTRY_BYTES, LONGEST_CACHED = 96 << 20, 240, 64
WHITE = re.compile(r"\s+")


class Encoder:
    """Encodes texts with one tokenizer file. One per Python worker.

    Text that spells an added token, as ``<|endoftext|>``, becomes that token, as the library does by
    default; with ``plain_special`` it is text like any other.
    """

    def __init__(self, path: str, plain_special: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_special and t.special)]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None
        pattern = WORD_LEVEL if self.lower else BYTE_LEVEL
        self.cut = re.compile(pattern).findall
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        plain = [c for c in map(chr, range(256)) if not PLAIN.match(c)]
        self.signs = {ord(c): "".join(x for x, _ in to_bytes(c)) for c in plain}  # characters as the model's byte signs
        self.cache: dict[str, bytes] = {}
        self.held = 0  # bytes, about

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> list[str]:
        """Have the library's model encode the pre-tokens that are not known yet; returns those too long to stay."""
        if self.held > MOST_CACHED:
            self.cache.clear()
            self.held = 0
        cache, tokenize, signs, long = self.cache, self.model.tokenize, self.signs, []
        for part in parts:
            if part not in cache:
                found = [t.id for t in tokenize(part.translate(signs))]
                cache[part] = struct.pack(f"<{len(found)}I", *found)
                if len(part) > LONGEST_CACHED:
                    long.append(part)
                else:
                    self.held += ENTRY_BYTES + len(part) + 4 * len(found)
        return long

    def one(self, text: str) -> bytes:
        """Ids of one text, without an end mark."""
        if PLAIN.search(text) or self.special.search(text):
            return self.whole([text])[0]
        parts = self.cut(text.lower() if self.lower else text)
        if len(parts) > 1:
            found = itemgetter(*parts)
            try:
                return b"".join(found(self.cache))
            except KeyError:
                pass
        long = self.learn(parts)
        out = b"".join([self.cache[x] for x in parts])
        for part in long:
            del self.cache[part]
        return out

    def batch(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Ids of each text (null: empty), each followed by ``end_id``."""
        end = np.array([end_id], dtype="<u4").tobytes()
        one = self.one
        return [one(t) + end if t else end for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``; workers serve many tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Give back the memory of encoders in a worker that goes on to other work."""
    if _encoders:
        _encoders.clear()
        tidy()


def tidy() -> None:
    """Return what earlier tasks of a worker have freed to the system: allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most_bytes`` of ``column``, each of one row at least."""
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], dtype=_offset_type(batch, column))[batch.column(column).offset :][: batch.num_rows + 1])
    at = np.cumsum(sizes) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _offset_type(batch: pa.RecordBatch, column: str) -> type:
    kind = batch.schema.field(column).type
    return np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else np.int32
