"""Vectorised 64-bit hashing of words in byte buffers (numpy, wrap-around arithmetic)."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240122)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)  # one random 64-bit value per byte
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z hash like a-z
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 16


def _powers(base: int) -> np.ndarray:
    a = np.full(_CHUNK, base, np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_UP_CHUNK, _DOWN_CHUNK = (np.uint64(pow(b, _CHUNK, 1 << 64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix constants)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if n <= _CHUNK:
        return _UP[:n], _DOWN[:n]
    rows = -(-n // _CHUNK)
    tall = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(rows - 1, step, np.uint64))))
            for step in (_UP_CHUNK, _DOWN_CHUNK)]
    return tuple((t[:, None] * row[None, :]).ravel()[:n] for t, row in zip(tall, (_UP, _DOWN)))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space (0x20, 0x09-0x0D), in order."""
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hashes of the given stretches; ``fold``: A-Z hash like a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = power_table(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``word_spans``, A-Z folded."""
    return span_hashes(data, *word_spans(data))


_SHINGLE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one shingle; no words, none."""
    n = len(words)
    if n == 0:
        return words
    runs, take = (n - width + 1, width) if n >= width else (1, n)
    z = np.full(runs, take, np.uint64)
    for j in range(take):
        z = mix(z ^ words[j:j + runs]) * _SHINGLE[j % 64]
    return np.unique(mix(z))
