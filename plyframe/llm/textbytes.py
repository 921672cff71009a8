"""Vectorised words and word shingles of a batch of texts, for use inside tasks.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, which on valid UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` on code points.  All work is done on the concatenated UTF-8 bytes of an Arrow batch,
in pieces of about one megabyte cut at blanks or between texts, so that memory stays bounded for long texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash over all others."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; text i is bytes[offsets[i]:offsets[i+1]], a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE, blank: np.ndarray = BLANK):
    """Cut points (begin, end) of pieces of about `size` bytes that end at a blank (a byte that `blank` marks) or at a text's end."""
    begin, n = 0, len(data)
    while begin < n:
        end = begin + size
        if end >= n:
            end = n
        else:
            at = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if at > begin:
                end = at
            else:
                while end < n and not blank[data[end]]:
                    end += 1
                end = min(end, int(offsets[np.searchsorted(offsets, begin, "right")]))
        yield begin, end
        begin = end


def spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = (~BLANK).astype(np.uint8)):
    """(begin, end) of the maximal runs of bytes of one non-zero kind, none of which crosses texts."""
    kind = kinds[data]
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    keep = kind[begin] > 0
    return begin[keep], end[keep]


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span of `data`."""
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, kinds: np.ndarray | None = None):
    """(hashes of the words, position of each text's first word) for a whole batch."""
    hashes, starts = [], []
    kinds = (~BLANK).astype(np.uint8) if kinds is None else kinds
    for a, b in pieces(data, offsets):
        part = LOWER[data[a:b]] if lower else data[a:b]
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        begin, end = spans(part, inner, kinds)
        hashes.append(hash_spans(part, begin, end))
        starts.append(begin + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(at, offsets)


def shingles(word: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text; a text of fewer words is one shingle, of none none."""
    if not len(word):
        return word
    size, short = min(n, len(word)), len(word) < n
    out = np.zeros(len(word) - size + 1, np.uint64)
    step = np.uint64(1)
    for j in range(size):
        out += word[j : len(word) - size + 1 + j] * step
        step = np.uint64((int(step) * int(_STEP)) % (1 << 64))
    return np.unique(mix(out + np.uint64(size if short else 0)))
