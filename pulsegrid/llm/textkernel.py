"""Vectorised word and shingle hashing over Arrow string columns (NumPy only).

Works on UTF-8 bytes of whole texts. A batch is cut into slices of bounded size, so
memory follows the largest single text rather than the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    n, at = len(col), col.offset
    off = np.frombuffer(col.buffers()[1], np.int64, count=n + 1 + at)[at:] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null may still own bytes
        col = pa.array([x or "" for x in col.to_pylist()], pa.large_string())
        return string_parts(col)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a slice of texts: byte ranges, 64-bit hashes and the range of words of each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, lower: bool = False):
        self.buf = buf = LOWER[buf] if lower else buf
        self.n = len(off) - 1
        gap = sep[buf]
        n = len(buf)
        if n:
            edge = np.zeros(n + 1, bool)
            edge[off] = True
            before = np.empty(n, bool)
            before[0], before[1:] = True, gap[:-1]
            after = np.empty(n, bool)
            after[-1], after[:-1] = True, gap[1:]
            self.start = np.flatnonzero(~gap & (before | edge[:-1]))
            self.end = np.flatnonzero(~gap & (after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: words of text i: first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, off, "left")
        self.gap = gap

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        power = np.full(n + 1, _P)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        inverse = np.full(n + 1, _PINV)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) << np.uint64(48)))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (the last k - 1 reach past the end and are only partly filled)."""
    out = np.zeros(len(words), np.uint64)
    for j in range(k):
        c = np.uint64((0xD6E8FEB86659FD93 * (2 * j + 3)) & (2**64 - 1))
        out[: len(words) - j] += mix(words[j:] * c + np.uint64(j + 1)) if j < len(words) else np.uint64(0)
    return mix(out)
