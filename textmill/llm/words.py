"""Hashes of the words of a text, as arrays."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text,
    A-Z lower-cased. The hash is a polynomial of the bytes modulo 2**64, mixed
    with the length."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw] + np.uint64(1)) * up, out=total[1:])
    h = (total[end] - total[start]) * down[start] if len(start) else np.empty(0, np.uint64)
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes, ascending, of ``size`` words in a row; of all words as one
    if there are fewer; none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        h = mix(h * np.uint64(3) + words[i : i + n] + np.uint64(i + 1))
    if len(words) < size:
        h = mix(h + np.uint64(len(words) * 0xA0761D6478BD642F & (1 << 64) - 1))
    return np.unique(h)
