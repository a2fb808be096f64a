"""NumPy scanning of Arrow string columns: words, lines and hashes of many texts at once.

Everything works on UTF-8 bytes. The word classes in use contain every byte above 0x7F or exclude only ASCII,
so byte-wise scanning finds exactly the code-point words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: White space as the contracts have it: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What is not in [^\x00-\x2F\x3A-\x60\x7B-\x7F].
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = True
NOT_ALNUM[0x3A:0x61] = True
NOT_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
CHUNK_BYTES = 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base modulo 2**64 and of its inverse, for spans of up to CHUNK_BYTES."""
    up = np.full(CHUNK_BYTES + 1, _BASE, np.uint64)
    down = np.full(CHUNK_BYTES + 1, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows with about `most` bytes together; a longer text is a run of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more entry at the end)."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~gap[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < data.size)]  # a word never runs from one row into the next
    start[inner] |= word[inner]
    end[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _long_hash(data: np.ndarray) -> int:
    """The unmixed hash of one span of any length, piece by piece."""
    up, _ = _powers()
    total, front, turn = 0, 1, pow(_BASE, CHUNK_BYTES, 1 << 64)
    for at in range(0, len(data), CHUNK_BYTES):
        piece = data[at : at + CHUNK_BYTES]
        total = (total + front * int(((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)]).sum(dtype=np.uint64))) & _MASK
        front = front * turn & _MASK
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; starts ascend. Prefix sums cover CHUNK_BYTES at a time, so a long text needs no more memory than its spans."""
    out = np.zeros(len(starts), np.uint64)
    up, down = _powers()
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = int(np.searchsorted(ends, base + CHUNK_BYTES, side="right"))
        if last <= first:
            out[first] = _long_hash(data[base : ends[first]])
            first += 1
            continue
        piece = data[base : ends[last - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        at = starts[first:last] - base
        out[first:last] = (total[ends[first:last] - base] - total[at]) * down[at]
        first = last
    return mix(out + (ends - starts).astype(np.uint64))


def by_row(values: np.ndarray, firsts: np.ndarray, ufunc: np.ufunc, empty: float) -> np.ndarray:
    """ufunc.reduce over the values of each row; `empty` for rows without any."""
    lengths = np.diff(firsts)
    out = np.full(len(lengths), empty, values.dtype)
    full = lengths > 0
    if full.any():
        out[full] = ufunc.reduceat(values, firsts[:-1][full])
    return out
