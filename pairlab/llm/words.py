"""Words and rolling hashes of whole text columns, vectorised over Arrow buffers.

Python tasks get a text column as one byte buffer.  Word bounds, word hashes and hashes of
every window of consecutive words are computed for a slice of documents at a time, with no
Python object per word.  A slice holds about ``SLICE_BYTES`` of text, or one document if that
is longer, which bounds a task's memory.

Hashes are Rabin-Karp polynomials over the ring of 64-bit integers with fixed random-looking
coefficients, taken from prefix sums, so a hash never depends on where in a slice a word is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = (1 << 20) - 1

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15 | 3
_WORD_BASES = (0xD1342543DE82EF95 | 3, 0xAF251AF3B0F025B5 | 3)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spread(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@lru_cache(maxsize=6)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        table = np.full(size, b, dtype=np.uint64)
        table[0] = 1
        out.append(np.cumprod(table, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(18, int(size - 1).bit_length()))


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = spread(256, 11)
_LOWER_VALUE = _BYTE_VALUE.copy()
_LOWER_VALUE[ord("A"): ord("Z") + 1] = _BYTE_VALUE[ord("a"): ord("z") + 1]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), offsets


@dataclass
class Words:
    """Words of some documents: byte bounds of each, and where each document's words begin."""

    at: int  # position of the first document in its batch
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; ``lower`` reads A-Z as a-z."""
        return span_hashes(self.buf, self.starts, self.ends, _LOWER_VALUE if lower else _BYTE_VALUE)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE_VALUE) -> np.ndarray:
    """64-bit hash of the bytes of each span, whatever its place in the buffer."""
    up, down = powers(_BYTE_BASE, len(buf) + 1)
    value = values[buf]
    value *= up[: len(value)]
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def bounds(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each document's first word."""
    inside = ~separator[buf]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of the documents of a column, about ``limit`` bytes at a time."""
    buf, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        part = offsets[i: j + 1] - offsets[i]
        piece = buf[offsets[i]: offsets[j]]
        yield Words(i, piece, *bounds(piece, part))
        i = j


def window_hashes(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` word values, by its first word; runs may cross documents."""
    if len(values) < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(_WORD_BASES[which], len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    n = len(values) - length + 1
    return mix((total[length:] - total[:n]) * down[:n])


def run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the word values of each stated run."""
    up, down = powers(_WORD_BASES[which], len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


def inside_document(first: np.ndarray, length: int) -> np.ndarray:
    """First words of the windows that lie in one document, in order."""
    n_windows = np.maximum(np.diff(first) - length + 1, 0)
    skip = np.repeat(first[:-1] - (np.cumsum(n_windows) - n_windows), n_windows)
    return np.arange(n_windows.sum()) + skip


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``length`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0
