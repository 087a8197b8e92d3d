"""Vectorised words, word hashes and shingles of one text, on its UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D; these bytes never occur inside a
multi-byte UTF-8 character, so that byte runs and character runs are the same.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHINGLE_KEY = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WINDOW = 1 << 17
_base = 0x9E3779B97F4A7C15
_inv = pow(_base, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POW, INV = _powers(_base, WINDOW + 1), _powers(_inv, WINDOW + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; long texts go window by window, cut between words."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = int(np.searchsorted(end, lo + WINDOW, "right"))
        if j == i:  # one word longer than a window
            out[i] = int.from_bytes(hashlib.blake2b(data[lo : end[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = BYTE_KEY[data[lo : end[j - 1]]]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * POW[: len(part)], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * INV[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * SHINGLE_KEY[:n]).sum(keepdims=True) + SHINGLE_KEY[n + 16])
    total = words[: n - k + 1] * SHINGLE_KEY[0]
    for i in range(1, k):
        total += words[i : n - k + 1 + i] * SHINGLE_KEY[i]
    return np.unique(mix(total))


def text_shingles(raw: bytes, k: int) -> np.ndarray:
    data = LOWER[np.frombuffer(raw, np.uint8)]
    s, e = spans(data)
    return shingle_hashes(hash_spans(data, s, e), k)


def texts_of(column):
    """The UTF-8 bytes of each value of an Arrow string column, empty for null."""
    import pyarrow as pa

    for x in column.cast(pa.binary()).to_pylist():
        yield x or b""
