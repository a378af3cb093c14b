"""Word shingles and their sketches as 64-bit numpy arrays; linear in the text, one text at a time."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(2_024)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 14)
        for name, base in (("up", 0xD6E8FEB86659FD93), ("down", pow(0xD6E8FEB86659FD93, -1, 2**64))):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, A-Z taken as a-z."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + _STEP * (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, one without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 * k % 2**64))
    for j in range(k):
        out += w[j : j + n] * _PLACE[j]
    return np.unique(mixed(out))


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=4)
def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(hashes: np.ndarray, n: int = 128) -> np.ndarray:
    """n 32-bit minimum hashes of a set that is not empty."""
    a, b = _families(n)
    out = np.full(n, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), 1024):
        out = np.minimum(out, ((hashes[k : k + 1024, None] * a + b) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key (as signed) for each band of `rows` minimum hashes."""
    s = signature.reshape(-1, rows).astype(np.uint64)
    return mixed((s * _PLACE[:rows]).sum(axis=1, dtype=np.uint64) + _STEP * np.arange(1, len(s) + 1, dtype=np.uint64)).view(np.int64)
