"""Words, shingle hashes and MinHash signatures of text batches, vectorised with numpy.

Hashes come from prefix sums over a batch's bytes: with an odd base B and arithmetic
modulo 2**64, the hash of a word is the difference of two prefix values divided by a power
of B, so no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LANES = np.random.default_rng(20240101).integers(1 << 62, (1 << 64) - 1, size=64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**0..n-1 and their inverses modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


#: Bytes that separate words: space and 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word of ``text``, A-Z taken as a-z."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(text, dtype=np.uint8)
    edge = np.ones(n + 2, dtype=bool)
    edge[1:-1] = _SPACE[raw]
    flips = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = flips[::2], flips[1::2]
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64))


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words are one shingle."""
    w = word_hashes(text)
    n = len(w)
    if n == 0:
        return w
    k = min(size, n)
    h = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h = mix(h + w[i : n - k + 1 + i] * _LANES[i])
    return np.unique(h)


def coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(97)
    return r.integers(1, 1 << 63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, size=k, dtype=np.uint64)


def signature(shingles: np.ndarray, k: int, step: int = 2048) -> np.ndarray:
    """``k`` MinHash coordinates as int32, in pieces of bounded memory."""
    a, b = coefficients(k)
    best = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), step):
        x = shingles[i : i + step]
        np.minimum(best, (x[:, None] * a[None, :] + b[None, :]).min(axis=0), out=best)
    return mix(best).astype(np.uint32).view(np.int32)  # low bits: the minimum itself is near 0
