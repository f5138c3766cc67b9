"""Two-stage suffix sorting and adjacent common prefixes, vectorised.

Texts are bytes with the value 0 as separator. Suffixes smaller than their successor
are sorted directly, by eight bytes at a time up to a depth; all others are induced by
one scan over the buckets of first bytes: the suffix before a sorted one goes to the
front of its own bucket.
"""

from __future__ import annotations

import numpy as np


def eight_bytes(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; the end is padded with 0."""
    t = np.concatenate((text, np.zeros(depth + 16, np.uint8))).astype(np.uint64)
    t = (t[:-1] << np.uint64(8)) | t[1:]
    t = (t[:-2] << np.uint64(16)) | t[2:]
    return (t[:-4] << np.uint64(32)) | t[4:]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the suffix behind it; the last is not."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    if not len(differs):
        return np.zeros(n, bool)
    # in a run of equal bytes all suffixes are like the one at its end
    at = np.searchsorted(differs, np.arange(n))
    known = at < len(differs)
    end = differs[np.minimum(at, len(differs) - 1)]
    return known & (text[end] < text[np.minimum(end + 1, n - 1)])


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Order ``places`` by the ``depth`` bytes that follow them."""
    key = words[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    for at in range(8, depth, 8):
        if not len(same):
            break
        tied = np.zeros(len(places), bool)
        tied[same] = tied[same + 1] = True
        tied = np.flatnonzero(tied)
        key = words[places[tied] + at]
        order = np.lexsort((key, group[tied]))
        places[tied], key = places[tied[order]], key[order]
        own = group[tied]
        new = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        label = np.concatenate(([0], np.cumsum(new)))
        group[tied] = label + len(places) * np.int64(at)  # apart from all other groups
        same = tied[:-1][~new]
    return places


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes by their first ``depth`` bytes, or up to a separator."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = eight_bytes(text, depth) if words is None else words
    small = smaller_than_next(text) & (text > 0)
    size = np.bincount(text, minlength=256)
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(n, np.int64)
    direct = sort_directly(np.flatnonzero(small), words, depth)
    direct_size = np.bincount(text[direct], minlength=256)
    taken = np.cumsum(direct_size) - direct_size
    front = begin[:-1].copy()

    def induce(block: np.ndarray, c: int, from_larger: bool) -> np.ndarray:
        """Put the suffixes before ``block`` into larger buckets; returns those for bucket ``c`` itself."""
        before = block[block > 0] - 1
        first = text[before]
        up = first > c
        to, values = first[up], before[up]
        order = np.argsort(to, kind="stable")
        count = np.bincount(to, minlength=256)
        inside = np.arange(len(values)) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(front, count) + inside] = values[order]
        front[:] += count
        return before[first == c] if from_larger else before[:0]

    if text[-1]:  # before the last suffix stands the end, which is smaller than all
        out[front[text[-1]]] = n - 1
        front[text[-1]] += 1
    for c in range(256):
        if not size[c]:
            continue
        if c == 0:
            out[: size[0]] = np.flatnonzero(text == 0)
            induce(out[: size[0]], 0, False)
            continue
        done = begin[c]
        while done < front[c]:
            block = out[done : front[c]].copy()
            done = front[c]
            again = induce(block, c, True)
            out[front[c] : front[c] + len(again)] = again
            front[c] += len(again)
        tail = direct[taken[c] : taken[c] + direct_size[c]]
        out[begin[c + 1] - len(tail) : begin[c + 1]] = tail
        induce(tail, c, False)
    return out


def adjacent_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Length of the prefix that each suffix shares with the next in order, ``depth`` at most."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.arange(len(out))
    for at in range(0, depth, 8):
        x = words[order[alive] + at] ^ words[order[alive + 1] + at]
        equal = x == 0
        rest = x[~equal]
        same = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            same += rest < np.uint64(1 << (64 - 8 * k))
        out[alive[~equal]] = at + same
        alive = alive[equal]
    out[alive] = depth
    return np.minimum(out, depth)
