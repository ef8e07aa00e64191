"""Words of many texts at once, found and hashed with numpy on their UTF-8 bytes.

Texts of an Arrow batch lie one after the other in one buffer. Word characters
are told by byte: every class used here takes all non-ASCII characters, whose
bytes are 0x80 and above, or decides ASCII bytes only, so no text is decoded.
A batch is worked on in pieces of about PIECE bytes; a single longer text is one
piece (about 60 bytes of memory for each of its bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Odd, so it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_class(keep) -> np.ndarray:
    """256 booleans: is the byte part of a word?"""
    return np.array([b >= 0x80 or keep(b) for b in range(256)])


#: Anything but a space, tab, line feed, vertical tab, form feed or carriage return.
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, letters and all non-ASCII characters.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Letters and all non-ASCII characters.
ALPHA = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    both = []
    for b in (BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, kept for sizes that come again."""
    size = max(PIECE, 1 << max(1, (n - 1).bit_length()))
    return _powers(size) if size <= 4 * PIECE else _powers.__wrapped__(size)


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal contents have equal hashes wherever they stand."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Words:
    """Words of a run of texts. Word i is data[start[i]:end[i]]; text t has words first[t]:first[t + 1]."""

    data: np.ndarray  # lower-cased bytes
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return range_hash(BYTE_VALUE[self.data], self.start, self.end)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z, and the capitals of U+00C0 to U+00DE, in lower case."""
    low = LOWER[data]
    if len(low) > 1:
        after = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[after] += 0x20
    return low


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type) or column.null_count:
        column = column.cast(pa.large_string()).fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_binary(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes, one text at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower=lambda d: LOWER[d]) -> Words:
    """The words of texts that lie one after the other; no word crosses from a text into the next."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets[:-1], none, none, np.zeros(len(offsets), np.int64))
    word = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(lower(data), offsets[:-1], start, end, np.searchsorted(start, offsets))


def words(column: pa.Array | pa.ChunkedArray, kind: np.ndarray, lower=lambda d: LOWER[d]) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for pieces of a column of texts."""
    data, offsets = texts_of(column)
    for lo, hi in pieces(offsets):
        part = offsets[lo : hi + 1]
        yield lo, hi, split(data[part[0] : part[-1]], part - part[0], kind, lower)


def distinct_per_text(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, sorted by both."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if not len(text):
        return text, value
    new = np.empty(len(text), dtype=bool)
    new[0] = True
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
