"""Sorted arrays in the shared folder, written by executors and memory-mapped by workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

import numpy as np

from .runtime import local_path

U = np.uint64


def is_local(path: str) -> bool:
    return path.startswith(("file:", "/"))


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write folder/name; the rename makes a retried task's file whole at any time."""
    if is_local(folder):
        base = local_path(folder)
        os.makedirs(base, exist_ok=True)
        own = f"{base}/.{name}-{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, values)
        os.replace(own, f"{base}/{name}")
        return
    import io

    from pyarrow import fs

    there, base = fs.FileSystem.from_uri(folder)
    there.create_dir(base, recursive=True)
    data = io.BytesIO()
    np.save(data, values)
    own = f"{base}/.{name}-{uuid.uuid4().hex}"
    with there.open_output_stream(own) as f:
        f.write(data.getbuffer())
    there.move(own, f"{base}/{name}")


_copies: dict[str, str] = {}


@atexit.register
def _drop_copies() -> None:
    for name in _copies.values():
        with contextlib.suppress(OSError):
            os.remove(name)


def map_array(folder: str, name: str) -> np.ndarray:
    """A read-only memory map of folder/name; of a store without local paths, of a worker's copy."""
    if is_local(folder):
        return np.load(f"{local_path(folder)}/{name}", mmap_mode="r")
    from pyarrow import fs

    key = f"{folder}/{name}"
    if key not in _copies:
        there, base = fs.FileSystem.from_uri(folder)
        own = tempfile.NamedTemporaryFile(suffix=".npy", delete=False)
        with there.open_input_stream(f"{base}/{name}") as f, own:
            while part := f.read(1 << 22):
                own.write(part)
        _copies[key] = own.name
    return np.load(_copies[key], mmap_mode="r")


def pack(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted keys and their counts by byte planes, which block compression shrinks well; counts beyond 32 bits take 64."""
    wide = [8 if len(c) and int(c.max()) >= 1 << 32 else 4 for c in counts]
    parts = [np.array([len(keys), len(counts), *wide], np.int64).tobytes(), keys.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    for c, k in zip(counts, wide):
        parts.append(c.astype(f"<u{k}").view(np.uint8).reshape(-1, k).T.tobytes())
    return b"".join(parts)


def packed_size(keys: int, *counts: np.ndarray) -> int:
    """Bytes of what pack() makes."""
    return 16 + 8 * len(counts) + 8 * keys + sum(keys * (8 if len(c) and int(c.max()) >= 1 << 32 else 4) for c in counts)


def unpack(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n, m = np.frombuffer(blob, np.int64, 2)
    wide, at, out = np.frombuffer(blob, np.int64, m, 16), 16 + 8 * int(m), []

    def plane(k: int) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * k, at).reshape(k, n).T).view(f"<u{k}").ravel()

    keys = plane(8)
    at += int(n) * 8
    for k in wide.tolist():
        out.append(plane(k))
        at += int(n) * k
    return keys, out


def merge(blobs: list[bytes], restore=None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys of packed blobs (each restored first, if asked) and the sums of their counts (int64)."""
    parts = [unpack(b) for b in blobs]
    keys = np.concatenate([restore(k) if restore else k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sums = []
    for j in range(len(parts[0][1])):
        c = np.concatenate([cs[j] for _, cs in parts])[order].astype(np.int64)
        sums.append(np.add.reduceat(c, first) if len(first) else c)
    return keys[first], sums


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the 64-bit space, in order."""
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


class SortedShards:
    """A globally sorted array in `buckets` mapped files; position = rank over all of them."""

    def __init__(self, folder: str, name: str, sizes: list[int]):
        self.sizes, self.folder, self.name = sizes, folder, name
        self.keys: dict[int, np.ndarray] = {}
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key of a sorted array of hashes, -1 if absent."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys):
            return out
        buckets = bucket_of(keys, len(self.sizes))
        cuts = np.searchsorted(buckets, np.arange(len(self.sizes) + 1))
        for b in np.unique(buckets):
            if not self.sizes[b]:
                continue
            if b not in self.keys:  # files are mapped as they are needed
                self.keys[b] = map_array(self.folder, f"{self.name}-{b}.npy")
            own, have = keys[cuts[b] : cuts[b + 1]], self.keys[b]
            at = np.searchsorted(have, own)
            ok = have[np.minimum(at, len(have) - 1)] == own
            out[cuts[b] : cuts[b + 1]][ok] = (at + self.offsets[b])[ok]
        return out


def within_bucket(keys: np.ndarray, bucket: np.ndarray, buckets: int) -> np.ndarray:
    """48 bits of hashed keys, counted from the beginning of their bucket (see bucket_of), in order."""
    n = U(buckets)
    low = ((bucket.astype(U) << U(32)) + n - U(1)) // n << U(32)
    return (keys - low) >> U(max(0, 17 - int(buckets).bit_length()))


class Packed:
    """Sorted 48-bit keys of each bucket in 6 bytes, with columns of counts in a byte where they fit.

    A bucket holds a bounded number of keys, so that two keys of one bucket are taken for one
    another with a bounded probability: n / 2**48 for n keys.
    """

    def __init__(self, folder: str, name: str, sizes: list[int], columns: tuple[str, ...] = ()):
        self.folder, self.name, self.sizes, self.columns = folder, name, sizes, columns
        self.files: dict[tuple[str, int], np.ndarray] = {}

    @staticmethod
    def save(folder: str, name: str, b: int, keys: np.ndarray, **columns: np.ndarray) -> None:
        save_array(folder, f"{name}-hi-{b}.npy", (keys >> U(16)).astype(np.uint32))
        save_array(folder, f"{name}-lo-{b}.npy", keys.astype(np.uint16))
        for c, v in columns.items():
            if v.dtype == np.int64:  # counts
                large = np.flatnonzero(v >= 255)
                save_array(folder, f"{name}-{c}-large-{b}.npy", np.array([large, v[large]]))
                v = np.minimum(v, 255).astype(np.uint8)
            save_array(folder, f"{name}-{c}-{b}.npy", v)

    def file(self, part: str, b: int) -> np.ndarray:
        if (part, b) not in self.files:
            self.files[part, b] = map_array(self.folder, f"{self.name}-{part}-{b}.npy")
        return self.files[part, b]

    def get(self, bucket: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(found, column, ...) of keys sorted by bucket; columns are 0 where a key isn't found."""
        found = np.zeros(len(keys), bool)
        out = [np.zeros(len(keys)) for _ in self.columns]
        which, first = np.unique(bucket, return_index=True)
        for b, a, e in zip(which.tolist(), first, np.append(first[1:], len(keys))):
            if not self.sizes[b]:
                continue
            hi, lo = self.file("hi", b), self.file("lo", b)
            high, low = (keys[a:e] >> U(16)).astype(np.uint32), keys[a:e].astype(np.uint16)
            at = np.searchsorted(hi, high)
            todo = np.arange(e - a)
            while len(todo):  # keys of equal high parts stand next to one another
                todo = todo[at[todo] < len(hi)]
                todo = todo[hi[at[todo]] == high[todo]]
                hit = lo[at[todo]] == low[todo]
                own = todo[hit]
                found[a + own] = True
                for c, o in zip(self.columns, out):
                    v = self.file(c, b)
                    values = v[at[own]].astype(np.float64)
                    if v.dtype == np.uint8 and (values == 255).any():
                        where, large = self.file(f"{c}-large", b)
                        top = np.flatnonzero(values == 255)
                        values[top] = large[np.searchsorted(where, at[own][top])]
                    o[a + own] = values
                todo = todo[~hit]
                at[todo] += 1
        return (found, *out)
