"""Word shingles of whole texts as sets of 64-bit hashes, vectorised over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in groups of about so many bytes, which bounds memory to some tens of bytes for each.
GROUP_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 modulo 2**64 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _INV)):
            with np.errstate(over="ignore"):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def running_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of bytes, for `span_hash`."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(len(data))[0], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes start .. end - 1, by content and length alone."""
    return mix64((total[end] - total[start]) * _power(len(total))[1][start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes that aren't ASCII white space, A-Z lowered) of all texts, and how many each has."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = span_hash(running_hash(data), start, end)
    counts = np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths)))))
    return h, counts


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct `width`-word shingles; with fewer words the whole sequence, without words none."""
    out: list[np.ndarray] = []
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= GROUP_BYTES or i == len(texts) - 1:
            out += _sets(texts[at : i + 1], width)
            at, size = i + 1, 0
    return out


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    h, counts = word_hashes(texts)
    mult = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(h)
    if n >= width:
        joined = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            joined += h[k : n - width + 1 + k] * mult[k]
        joined = mix64(joined)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(joined[at : at + c - width + 1]))
        elif c:
            own = h[at : at + c] * mult[:c]
            out.append(mix64(own.sum(keepdims=True, dtype=np.uint64) + np.array([c], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


class MinHasher:
    """`size` min-wise hashes of sets of 64-bit words, as unsigned 32-bit values."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, (size, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (size, 1), dtype=np.uint32)

    def __call__(self, s: np.ndarray, step: int = 1024) -> np.ndarray:
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        low = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for i in range(0, len(low), step):
            x = low[i : i + step] * self.a
            x += self.b
            np.minimum(best, x.min(1), out=best)
        return best


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, int]:
    """Whether 100 * |a & b| >= percent * |a | b|, and |a & b|, for sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both), both
