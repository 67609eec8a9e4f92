"""Names (64-bit hashes) of words, straight from Arrow's UTF-8 buffers.

A word is a maximal stretch of bytes other than space and U+0009 to U+000D. Every byte value stands for a fixed random number;
a word's hash is the sum of its bytes' numbers times powers of an odd number, modulo 2^64, taken from one running sum over
the whole buffer, so no word becomes a Python object. Names are the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of texts looked at once, and of words hashed at once.
SLICE_BYTES, PIECE = 1 << 20, 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(2)
def _values(fold_case: bool) -> np.ndarray:
    """A number for each byte value; with fold_case A-Z have those of a-z."""
    numbers = mix(np.arange(1, 257, dtype=np.uint64) * M2)
    if fold_case:
        numbers[65:91] = numbers[97:123]
    return numbers


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of M1 and of its inverse modulo 2^64."""
    inverse = pow(int(M1), -1, 1 << 64)
    both = []
    for factor in (int(M1), inverse):
        p = np.full(size, factor, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


_usual_powers = lru_cache(1)(lambda: _powers(PIECE + 1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def documents(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, edges) of stretches of a batch with about `most` bytes of text (one document at least)."""
    raw, edges = buffers(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + most, side="right")) - 1)
        end = min(end, batch.num_rows)
        yield begin, end, raw[edges[begin] : edges[end]], edges[begin : end + 1] - edges[begin]
        begin = end


def word_names(raw: np.ndarray, edges: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(names of all words, number of words before each document and at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    space = _SPACE[raw]
    cut = np.zeros(n + 1, bool)  # a document begins here
    cut[edges] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    names, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # the words that fit a piece, or one longer word
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        size = int(ends[j - 1] - low)
        up, down = _usual_powers() if size <= PIECE else _powers(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_values(fold_case)[raw[low : low + size]] * up[:size], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        names[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * M2)
        i = j
    return names, np.searchsorted(starts, edges)


def grams(names: np.ndarray, n: int, by: np.uint64) -> np.ndarray:
    """Name of the n words from each position on (those that fit)."""
    out, factor = np.zeros(max(len(names) - n + 1, 0), np.uint64), 1
    for j in range(n if len(out) else 0):
        out += names[j : j + len(out)] * np.uint64(factor)
        factor = factor * int(by) & (1 << 64) - 1
    return mix(out)
