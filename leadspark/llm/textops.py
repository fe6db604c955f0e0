"""Vectorised byte-level text helpers used inside Arrow tasks.

Everything here works on a block of whole texts laid end to end as UTF-8 bytes, so a
block costs a handful of numpy passes whatever the number of documents in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Text bytes handled by one numpy pass; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about ``limit`` bytes each, one row at least.

    A text is never split, and the arrays made of a block take up to forty bytes of memory for each of its bytes, so a single
    text of over some 50 MB needs a larger executor.
    """
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, kept for the next block up to a few megabytes."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, 1 << 16)
    made = []
    for base in (BASE, BASE_INV):
        p = np.full(size, base, U64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= 4 * BLOCK_BYTES:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


class RollingHash:
    """Hash of any byte range of a block in constant time.

    The value of a range is a polynomial over random byte values, taken relative to the start
    of the range and mixed, so equal bytes give equal hashes wherever they stand.
    """

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUES[data] * power[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(value + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every run of bytes other than space and \\x09-\\x0D."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    ink = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = ink
    after = np.empty(n + 1, bool)
    after[:-1] = ink
    after[-1] = False
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, docs


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every lower-cased (A-Z) word, with its start, end and document index."""
    starts, ends, docs = words(data, offsets)
    return RollingHash(lower_ascii(data)).ranges(starts, ends), starts, ends, docs


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width``-word shingle and their document index, in text order.

    A document of fewer words gives its whole word sequence as one shingle; one without words
    gives none.
    """
    value, _, _, docs = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    if not len(value):
        return value, docs
    count = np.bincount(docs, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    position = np.arange(len(value)) - first[docs]
    left = count[docs] - position
    is_start = (left >= width) | (position == 0)
    at = np.flatnonzero(is_start)
    total = np.zeros(len(at), U64)
    remaining = left[at]
    multiplier = 0x8CB92BA72F3D8DD7
    for j in range(width):
        inside = remaining > j
        nxt = value[np.minimum(at + j, len(value) - 1)]
        total = total * U64(multiplier) + np.where(inside, nxt, U64(0x51ED270B))
    total = mix(total + np.minimum(remaining, width).astype(U64))
    return total, docs[at]


def distinct_sets(value: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, laid end to end, with n_docs+1 offsets."""
    order = np.lexsort((value, docs))
    value, docs = value[order], docs[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (docs[1:] != docs[:-1])
    value, docs = value[keep], docs[keep]
    return value, np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=n_docs)))).astype(np.int64)
