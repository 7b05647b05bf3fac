"""Hashes of the words of many texts at once, with numpy over the bytes of a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n-1 modulo 2^64; kept for the largest n so far."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(n, base, dtype=np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        _powers[base] = kept
    return kept[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``hash`` of each word; ``first[d]`` to ``first[d + 1]`` are the words of text ``d``."""

    hash: np.ndarray
    first: np.ndarray


def word_hashes(texts: pa.Array, only_letters: bool = False) -> Words:
    """Words are runs of bytes other than ASCII white space, A-Z counted as a-z; null texts have none.

    ``only_letters``: letters, figures and bytes beyond ASCII make up words, all else parts them.
    """
    texts = texts.cast(pa.large_string()) if texts.null_count == 0 else pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    cuts = offsets - offsets[0]
    data = LOWER[data]
    inside = LETTER[data] if only_letters else ~SPACE[data]
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[cuts] = True  # a word ends with its text
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:]))
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), sums))
    value = (sums[ends + 1] - sums[starts]) * _power(INVERSE, len(data) + 1)[starts]
    return Words(mix(value), np.searchsorted(starts, cuts))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words at each word that has ``n - 1`` after it, over text borders too."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(BASE) + words[k : k + len(total)]
    return mix(total)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over each ``width`` neighbours from a place on; shorter at the end."""
    out, span = x.copy(), 1
    while span < width:
        step = min(span, width - span)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:]) if step < len(out) else out[: len(out) - step]
        span += step
    return out
