"""Static 3-wise binary fuse filters over 64-bit keys (Graf and Lemire, 2022), built and asked with numpy.

A filter is built once from a fixed key set and never changed: each key owns one of
three cells in neighbouring segments, and the xor of its three cells is its 8-bit
fingerprint. Members always answer yes; of the others about 1 in 256 does.
"""

from __future__ import annotations

import math

import numpy as np

from capshift.llm.hashing import mix

ARITY = 3
TRIES = 200


def layout(n: int) -> tuple[int, int]:
    """(segment length, number of start segments) for ``n`` keys."""
    length = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    return length, max(1, math.ceil(room / length) - (ARITY - 1))


def _cells(keys: np.ndarray, seed: int, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of every key, one row each, and its fingerprint."""
    h = mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    first = ((h >> np.uint64(32)) * np.uint64(starts * length)) >> np.uint64(32)
    mask, step = np.uint64(length - 1), np.uint64(length)
    cells = np.stack([first, (first + step) ^ ((h >> np.uint64(18)) & mask), (first + step + step) ^ (h & mask)])
    return cells.astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, start segments, cells) of the distinct ``keys`` (uint64, at least one)."""
    keys = np.unique(keys)
    n = len(keys)
    length, starts = layout(n)
    for seed in range(TRIES):
        cells, prints = _cells(keys, seed, length, starts)
        order = _peel(cells, (starts + ARITY - 1) * length, n)
        if order is None:
            continue
        table = np.zeros((starts + ARITY - 1) * length, np.uint8)
        for who, own in reversed(order):
            # cells of one round belong to one key each, so a round is filled at once
            table[own] = 0
            three = cells[:, who]
            table[own] = prints[who] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
        return seed, length, starts, table.tobytes()
    raise RuntimeError(f"no binary fuse filter of {n} keys in {TRIES} seeds")


def _peel(cells: np.ndarray, size: int, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell only that key still uses), or None if some keys never stand alone."""
    flat = cells.ravel()
    count = np.bincount(flat, minlength=size)
    total = np.zeros(size, np.int64)
    np.add.at(total, flat, np.tile(np.arange(n), ARITY))  # with one key left, the sum is that key
    order, left, alone = [], n, np.flatnonzero(count == 1)
    while len(alone):
        who, at = np.unique(total[alone], return_index=True)
        order.append((who, alone[at]))
        left -= len(who)
        touched = cells[:, who].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(who, ARITY))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return order if left == 0 else None


def contains(keys: np.ndarray, seed: int, length: int, starts: int, cells: bytes) -> np.ndarray:
    """True for every member, and for few others."""
    three, prints = _cells(keys, seed, length, starts)
    table = np.frombuffer(cells, np.uint8)
    return table[three[0]] ^ table[three[1]] ^ table[three[2]] == prints
