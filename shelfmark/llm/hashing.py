"""Vectorised hashing of words and windows over whole buffers of text."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
#: Random value of each byte, for two independent hashes.
BYTE = _RNG.integers(1, 1 << 63, (2, 256), np.uint64) | np.uint64(1)
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither letter nor digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes or words that are handled at once; keeps arrays in the cache.
SLAB = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run without ``blank`` bytes), and its document."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~blank[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = solid[heads]
    last[heads[1:] - 1] = solid[heads[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, by sums over slabs of bytes; a word beyond a slab is added up by parts."""
    out = np.zeros(len(start), np.uint64)
    table, base = BYTE[which], BASE[which]
    power, back = powers(SLAB, base), powers(SLAB, inverse(base))
    at = 0
    while at < len(start):
        lo = int(start[at])
        stop = int(np.searchsorted(end, lo + SLAB, "right"))
        if stop <= at:
            for a in range(lo, int(end[at]), SLAB):
                part = data[a : min(int(end[at]), a + SLAB)]
                scale = np.full(1, pow(int(base), a - lo, 1 << 64), np.uint64)
                out[at : at + 1] += np.sum(table[part] * power[: len(part)], dtype=np.uint64, keepdims=True) * scale
            at += 1
            continue
        part = data[lo : int(end[stop - 1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * power[: len(part)], out=total[1:])
        a, b = start[at:stop] - lo, end[at:stop] - lo
        out[at:stop] = (total[b] - total[a]) * back[a]
        at = stop
    return mix(out + (end - start).astype(np.uint64) * BASE[1 - which])


def windows(h: np.ndarray, n: int, base: np.uint64 = BASE[0]) -> np.ndarray:
    """Hash of every run of ``n`` values, built by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, out = 0, None
    block, size, power = h, 1, base
    while True:
        if n & size:
            if out is None:
                out, done = block, size
            else:  # place the block behind what there is
                m = len(h) - done - size + 1
                out = out[:m] * power + block[done : done + m]
                done += size
        if done == n:
            return out[: len(h) - n + 1]
        block = block[: len(block) - size] * power + block[size:]
        size, power = size * 2, np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` values the place of its least value, the first of equals.

    Values are compared by their upper 42 bits, so the choice depends on the
    contents of the window only, not on where it lies.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for a in range(0, n, SLAB):
        b = min(n, a + SLAB)
        part = h[a : b + w - 1]
        m = (part & np.uint64(0xFFFFFFFFFFC00000)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            m = np.minimum(m[: len(m) - size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        out[a:b] = (m & np.uint64(0x3FFFFF)).astype(np.int64) + a
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    if not len(values):
        empty = np.zeros(0, np.int64)
        return empty, empty
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)]))
