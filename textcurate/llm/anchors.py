"""Content-defined phrases of a byte string: rolling hashes and the minima of sliding windows."""

from __future__ import annotations

import numpy as np

from .hashing import _BASE, _INV, U, byte_values, mix, powers


class Rolling:
    """Hashes of any substring of a buffer, from one running polynomial sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.run = np.zeros(n + 1, U)
        self.back = powers(_INV, n + 1)
        with np.errstate(over="ignore"):
            np.cumsum(byte_values(False)[buf] * powers(_BASE, max(n, 1))[:n], out=self.run[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.run[ends] - self.run[starts]) * self.back[starts] + (ends - starts).astype(U))

    def all(self, width: int) -> np.ndarray:
        """Of each substring of `width` bytes."""
        n = len(self.run) - 1
        if n < width:
            return np.empty(0, U)
        with np.errstate(over="ignore"):
            return mix((self.run[width:] - self.run[:-width]) * self.back[: n - width + 1] + U(width))


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, by doubling."""
    m, k, v = len(values) - width + 1, 1, values
    if m <= 0:
        return values[:0]
    while 2 * k <= width:
        v = np.minimum(v[: len(v) - k], v[k:])
        k *= 2
    return np.minimum(v[:m], v[width - k : width - k + m])


def phrases(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger value, first window, windows, several) of the runs of windows that share their minimum.

    several: the trigger occurs more than once in the run, so its own windows may be equal.
    """
    low = sliding_minima(values, width)
    none = np.empty(0, np.int64)
    if not len(low):
        return low, none, none, none.astype(bool)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(first, len(low)))
    several = np.empty(len(first), bool)
    step = np.arange(width)
    for a in range(0, len(first), 1024):
        f, n = first[a : a + 1024], count[a : a + 1024]
        left = f + values[f[:, None] + step].argmin(1)
        last = f + n - 1
        right = last + width - 1 - values[(last + width - 1)[:, None] - step].argmin(1)
        several[a : a + 1024] = left != right
    return low[first], first, count, several
