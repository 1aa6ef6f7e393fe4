"""Words of whole text columns as numpy arrays, for the operators that run in Arrow batches.

A batch's texts lie in one UTF-8 buffer. Word ends, folding of A-Z and a 64-bit hash of each word come from a few
array operations over that buffer, without a Python object per word. Both word rules in use are rules on bytes,
since every byte of a non-ASCII character is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BYTES = np.arange(256)

#: A-Z to a-z, all else as it is.
FOLD = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
KEEP = _BYTES.astype(np.uint8)
#: ``[^\x20\x09-\x0D]+``
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding: digits, letters and all beyond ASCII.
LETTERED = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 17


class Words(NamedTuple):
    """Words of some texts: ``first[i]`` to ``first[i + 1]`` are those of text i; start and end are bytes in data."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that memory follows the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.cumsum(np.concatenate([[0], np.diff(buffers(batch.column(text))[1]) + 64]))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def words(texts: pa.Array, is_word: np.ndarray = SPACED, fold: np.ndarray = FOLD) -> Words:
    raw, at = buffers(texts)
    data = fold[raw]
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    end = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, at))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * _BLOCK)
        up = np.full(size, _BASE, U64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def hashes(found: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process: a polynomial over the bytes from running sums,
    with the word's length mixed in. Blocks keep memory bounded."""
    out = np.empty(len(found.start), U64)
    w = 0
    while w < len(out):
        low = int(found.start[w])
        stop = max(w + 1, int(np.searchsorted(found.end, low + _BLOCK, "right")))
        high = int(found.end[stop - 1])
        up, down = _powers(high - low)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum((found.data[low:high].astype(U64) + U64(1)) * up[: high - low], out=sums[1:])
        s, e = found.start[w:stop] - low, found.end[w:stop] - low
        out[w:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xA0761D6478BD642F))
        w = stop
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive words from each place on; where fewer follow, the last entries are missing."""
    if len(h) < n:
        return np.zeros(0, U64)
    total = np.zeros(len(h) - n + 1, U64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * U64(pow(0xE7037ED1A0B428DB, 2 * j + 1, 1 << 64))
    return mix(total)


def within(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which n words of one text begin, and where each text's places begin in that list."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], counts), at
