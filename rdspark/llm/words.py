"""Words of whole Arrow batches as 64-bit hashes, with NumPy over the bytes: no Python object per word.

A batch is worked on in slabs of about SLAB bytes of text, cut between rows; one longer text is a slab of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLAB = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_ALNUM = np.ones(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    NOT_ALNUM[_a:_b + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def slabs(batch: pa.RecordBatch, column: str = "text", size: int = SLAB):
    """(first row, slice of the batch, bytes, row offsets) for runs of rows of about ``size`` bytes. No nulls."""
    col = batch.column(column)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(col):
        end = max(k + 1, int(np.searchsorted(offs, offs[k] + size, "right")) - 1)
        yield k, batch.slice(k, end - k), data[offs[k]:offs[end]], offs[k:end + 1] - offs[k]
        k = end


def spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of a slab, and for each row the number of words before it (one more at the end)."""
    word = ~separator[data]
    start, last = word.copy(), word.copy()
    if len(data):
        start[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first = offs[:-1][offs[:-1] < offs[1:]]
        start[first] = word[first]
        final = offs[1:][offs[:-1] < offs[1:]] - 1
        last[final] = word[final]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from prefix sums of a polynomial over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False, separator: np.ndarray = SPACE):
    """(hash per word, words before each row)."""
    if lower:
        data = LOWER[data]
    starts, ends, before = spans(data, offs, separator)
    return hashes(data, starts, ends), before


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (row ends are not looked at)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _STEP
        g += h[j:j + n]
    return mix(g)


def shingle_sets(h: np.ndarray, before: np.ndarray, k: int = 5):
    """For each row the sorted distinct hashes of its k-word shingles; fewer words: the whole sequence as one; none: empty."""
    g = grams(h, k)
    for a, b in zip(before[:-1], before[1:]):
        if b - a >= k:
            s = np.sort(g[a:b - k + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = np.uint64((int(whole) * int(_STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
