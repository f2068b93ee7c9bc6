"""Suffix order and longest-previous-factor arrays of byte arrays, by ranks of growing depth."""

from __future__ import annotations

import numpy as np


def ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """For each position the rank of its next ``depth`` bytes (beyond the end: zeros) in lexicographic order; equal strings have equal ranks.

    The first ranks are of 8 bytes; each round triples the depth by joining ranks of three places, for the positions
    whose ranks aren't yet their own. The data must be shorter than 2 million bytes.
    """
    n = len(data)
    if n >= 1 << 21:
        raise ValueError("too long for one suffix order")
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    for k in range(depth, 8):
        key &= ~(np.uint64(255) << np.uint64(56 - 8 * k))
    rank = np.zeros(n, np.int64)
    left, old, d = np.arange(n), np.zeros(n, np.int64), min(8, depth)
    base = np.int64(n + 1)
    while True:
        by = np.argsort(key, kind="stable")
        key, old = key[by], old[by]
        at = np.arange(len(by))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], old[1:] != old[:-1]))
        within = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank[left[by]] = old + within
        if d >= depth:
            return rank
        alone = new & np.concatenate((new[1:], [True]))
        left = np.sort(left[by[~alone]])
        if not len(left):
            return rank
        to = min(3 * d, depth)
        a, b = min(d, to - d), to - d
        behind = np.concatenate([rank + 1, np.zeros(to, np.int64)])
        old = rank[left]
        key = (old * base + behind[left + a]) * base + behind[left + b]
        d = to


def previous_factors(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts`` the start of an earlier and of a later occurrence of its next ``depth`` bytes among them, -1 if there is none.

    The longest previous factor of a position is found at its previous or next smaller position in suffix order.
    Suffixes that are equal to ``depth`` are ordered by position here, so for a factor of that length the previous
    smaller position is the neighbour before, and, looking for later ones, the next is the neighbour behind.
    """
    rank = ranks(data, depth)[starts]
    order = np.lexsort((starts, rank))
    same = rank[order][1:] == rank[order][:-1]
    earlier, later = np.full(len(starts), -1, np.int64), np.full(len(starts), -1, np.int64)
    earlier[order[1:][same]] = starts[order[:-1][same]]
    later[order[:-1][same]] = starts[order[1:][same]]
    return earlier, later


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minima of all windows of ``width``, by running minima within blocks from both sides."""
    m = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
