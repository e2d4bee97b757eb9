"""Suffix order of byte strings to a fixed depth, by doubling the prefixes that still tie."""

from __future__ import annotations

import numpy as np

from .hashing import U


def suffix_ranks(buf: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of buf by its first `depth` bytes; suffixes that agree there have equal ranks.

    A rank is the number of suffixes before it, so a tie that is refined keeps its place:
    ranks that are unique already are never sorted again. The end sorts before any byte.
    """
    n = len(buf)
    if not n:
        return np.empty(0, np.int64)
    wide = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(U)
    first, h = np.zeros(n, U), min(8, depth)
    for k in range(h):
        first |= wide[k : n + k] << U(56 - 8 * k)
    # a zero byte and the end look the same here; the number of bytes left decides between them
    left = np.minimum(np.arange(n, 0, -1), h)
    order = np.lexsort((left, first))
    rank = _ranked(order, (first[order][1:] != first[order][:-1]) | (left[order][1:] != left[order][:-1]))
    while h < depth:
        step = min(h, depth - h)
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        then = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        order = np.lexsort((then, rank[tied]))
        own, then = rank[tied][order], then[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])])
        group = np.concatenate([[True], own[1:] != own[:-1]])
        at = np.arange(len(tied))
        first_of_group = np.maximum.accumulate(np.where(group, at, 0))
        first_of_new = np.maximum.accumulate(np.where(new, at, 0))
        refined = np.empty(len(tied), np.int64)
        refined[order] = own + first_of_new - first_of_group
        rank = rank.copy()
        rank[tied] = refined
        h += step
    return rank


def _ranked(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    at = np.where(np.concatenate([[True], differs]), np.arange(len(order)), 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(at)
    return rank
