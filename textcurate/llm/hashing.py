"""Vectorised tokenising and hashing of whole batches of texts with numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes hashed at once; bounds the memory of a Python worker.
CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
_INV = pow(_BASE, -1, 1 << 64)
_MULT = _rng.integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | U(1)
_pows: dict[int, np.ndarray] = {}

#: Words are runs of bytes outside these separators: space and \\t \\n \\v \\f \\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    have = _pows.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK)
        out = np.empty(size, U)
        out[0] = 1
        with np.errstate(over="ignore"):
            k = 1
            while k < size:
                step = U(pow(base, k, 1 << 64))
                out[k : 2 * k] = out[: min(k, size - k)] * step
                k *= 2
        _pows[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The value whose mix() is x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31)) ^ (x >> U(62))) * U(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = (x ^ (x >> U(27)) ^ (x >> U(54))) * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U(30)) ^ (x >> U(60))


def byte_values(lower: bool) -> np.ndarray:
    t = _BYTE.copy()
    if lower:
        t[65:91] = t[97:123]
    return t


def word_spans(buf: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a buffer."""
    edge = np.empty(len(buf) + 2, np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~separators[buf]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, from one running polynomial sum over each chunk."""
    table, out, n = byte_values(lower), np.empty(len(starts), U), len(starts)
    i = 0
    with np.errstate(over="ignore"):
        while i < n:
            a = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, a + CHUNK, "right")))
            b = int(ends[j - 1])
            run = np.zeros(b - a + 1, U)
            np.cumsum(table[buf[a:b]] * powers(_BASE, b - a), out=run[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (run[e] - run[s]) * powers(_INV, b - a + 1)[s]
            i = j
    return mix(out)


def batches(texts: Sequence[str | None] | pa.Array, limit: int = 2 * CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buffer, bounds): texts joined by newlines, about `limit` bytes at a time; null is empty.

    Of an Arrow array the bytes are taken as they lie, without a Python string for each.
    """
    if not isinstance(texts, pa.Array):
        texts = pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)
    at = np.frombuffer(texts.buffers()[1], kind, n + 1, texts.offset * kind.itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if n else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "left"))))
        ends = at[i + 1 : j + 1] - at[i]
        yield i, j, np.insert(data[at[i] : at[j]], ends, 10), np.concatenate([[0], ends + np.arange(1, j - i + 1)])
        i = j


def words_of(texts: Sequence[str | None] | pa.Array, lower: bool = True, limit: int = 2 * CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, bounds of each text's words) for batches of texts."""
    for i, _, buf, bounds in batches(texts, limit):
        s, e = word_spans(buf)
        yield i, hash_words(buf, s, e, lower), np.searchsorted(s, bounds)


def shingle_sets(texts: Sequence[str | None] | pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, sorted distinct 64-bit hashes of its word shingles).

    A text of fewer words is one shingle of all its words; no words give an empty set.
    """
    for first, w, at in words_of(texts):
        with np.errstate(over="ignore"):
            n = max(0, len(w) - width + 1)
            acc = np.zeros(n, U)
            for k in range(width):
                acc += w[k : k + n] * _MULT[k]
            full = mix(acc)
            for d in range(len(at) - 1):
                a, b = int(at[d]), int(at[d + 1])
                if b - a >= width:
                    yield first + d, np.unique(full[a : b - width + 1])
                elif b > a:
                    yield first + d, mix(np.array([(w[a:b] * _MULT[: b - a]).sum() + U(b - a)], U))
                else:
                    yield first + d, np.empty(0, U)


def digest(values: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted hash array."""
    with np.errstate(over="ignore"):
        n = len(values)
        s = mix(values + mix(np.arange(1, n + 1, dtype=U))).sum(dtype=U) + U(n)
        return int(mix(np.array([s], U)).view(np.int64)[0])
