"""Keys counted over a corpus, and values by key, as sorted files in the shared folder that workers map.

With them a scan over texts learns what it needs about its own rows without a join, so texts
are never shuffled. The driver holds a number for each file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SortedShards, bucket_of, map_array, merge, pack, packed_size, save_array
from .hashing import U
from .runtime import lean, materialize, work_dir

#: Leading bits of a key that are compared; a collision only adds work.
KEY_BITS = 48
MASK = U(((1 << KEY_BITS) - 1) << (64 - KEY_BITS))
WHOLE_KEY = U((1 << 64) - 1)
#: Keys that a task gathers before it sorts and sends their counts.
GATHER = 1 << 22
#: Values of one file, about.
VALUES = 1 << 19


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte, in their order: up to 128 as they are, beyond that by four steps for each doubling (2^39 and more are one)."""
    return np.minimum(np.where(counts <= 128, counts, 128 + np.floor(4 * np.log2(np.maximum(counts, 128) / 128))), 255).astype(np.uint8)


class SharedKeys:
    """Keys that occur several times, and how often, in mapped sorted files."""

    def __init__(self, folder: str, sizes: list[int], mask: np.uint64 = MASK):
        self.mask, self.folder, self.shards = mask, folder, SortedShards(folder, "keys", sizes)
        self.counts: dict[int, np.ndarray] = {}

    def times(self, keys: np.ndarray) -> np.ndarray:
        """Times that each key (any order) occurs, by scaled(); 1 for those that aren't in the files."""
        distinct, back = np.unique(keys & self.mask, return_inverse=True)
        rank = self.shards.find(distinct)
        out = np.ones(len(distinct), np.uint8)
        which = np.searchsorted(self.shards.offsets, rank, "right") - 1
        for b in np.unique(which[rank >= 0]):
            sel = (which == b) & (rank >= 0)
            if b not in self.counts:
                self.counts[b] = map_array(self.folder, f"counts-{b}.npy")
            out[sel] = self.counts[b][rank[sel] - self.shards.offsets[b]]
        return out[back]


def count_keys(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], mask: np.uint64 = MASK) -> tuple[str, list[int]]:
    """Folder and file sizes of the 64-bit keys that keys_of gives several times over all batches of rows.

    Tasks send sorted blocks of keys and counts, cut by key range, which takes repeats
    together before the shuffle; each range is merged into one file.
    """
    spark = rows.sparkSession
    folder = work_dir(spark, "keys")
    ranges = min(1 << 16, max(16, 4 * rows.rdd.getNumPartitions()))

    def blocks(held):
        keys, counts = np.unique(np.concatenate(held) & mask, return_counts=True)
        bucket = bucket_of(keys, ranges)
        which = np.unique(bucket)
        cuts = np.searchsorted(bucket, np.append(which, ranges))
        blobs = [pa.compress(pack(np.diff(keys[a:e], prepend=U(0)).astype(U), counts[a:e]), "zstd", asbytes=True) for a, e in zip(cuts[:-1], cuts[1:])]
        sizes = [packed_size(int(e - a), counts[a:e]) for a, e in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "size", "blob"])

    def count(batches):
        held, size = [], 0
        for k in keys_of(batches):
            held.append(k)
            size += len(k)
            if size >= GATHER:
                yield blocks(held)
                held, size = [], 0
        if size:
            yield blocks(held)

    def gather(t: pa.Table) -> pa.Table:
        b = t["bucket"][0].as_py()
        raw = [pa.decompress(x.as_py(), n, "zstd", asbytes=True) for x, n in zip(t["blob"], t["size"].to_pylist())]
        keys, (counts,) = merge(raw, np.cumsum)
        several = counts > 1
        save_array(folder, f"keys-{b}.npy", keys[several])
        save_array(folder, f"counts-{b}.npy", scaled(counts[several]))
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([int(several.sum())], pa.int64())})

    sizes = [0] * ranges
    found = rows.mapInArrow(lean(count), "bucket int, size long, blob binary").groupBy("bucket").applyInArrow(gather, "bucket int, n long")
    for r in found.collect():
        sizes[r["bucket"]] = r["n"]
    return folder, sizes


class Values:
    """The distinct values of a key, from files that write_values wrote."""

    def __init__(self, where: tuple[str, int, set[int], int]):
        self.folder, self.bits, self.present, self.width = where
        self.files: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def get(self, key: int) -> np.ndarray | None:
        """Sorted values of a signed 64-bit key (a row each, if there are several columns); None if it has none."""
        k = key & ((1 << 64) - 1)
        b = k >> (64 - self.bits)
        if b not in self.present:
            return None
        if b not in self.files:
            self.files[b] = tuple(map_array(self.folder, f"{n}-{b}.npy") for n in ("keys", "starts", "values"))
        keys, starts, values = self.files[b]
        at = int(np.searchsorted(keys, U(k)))
        return values[starts[at] : starts[at + 1]] if at < len(keys) and keys[at] == U(k) else None


def write_values(rows: DataFrame, name: str, values: tuple[str, ...] = ("value",)) -> tuple[str, int, set[int], int]:
    """Write rows of a key and values (all long) as sorted files; what Values needs to read them.

    A key is a document's hash and its values are places in that document, so no key is hot.
    """
    rows = materialize(rows.select("key", *values), name)
    folder = work_dir(rows.sparkSession, name + "-values")
    bits = max(4, (rows.count() // VALUES).bit_length())

    def gather(t: pa.Table) -> pa.Table:
        b = t["bucket"][0].as_py()
        keys, columns = t["key"].to_numpy().view(U), [t[v].to_numpy() for v in values]
        order = np.lexsort((*columns[::-1], keys))
        keys, columns = keys[order], np.column_stack([c[order] for c in columns])
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        keep = new | np.concatenate([[True], (columns[1:] != columns[:-1]).any(1)])
        keys, columns, new = keys[keep], columns[keep], new[keep]
        save_array(folder, f"keys-{b}.npy", keys[new])
        save_array(folder, f"starts-{b}.npy", np.append(np.flatnonzero(new), len(keys)))
        save_array(folder, f"values-{b}.npy", columns if len(values) > 1 else columns[:, 0].copy())
        return pa.table({"bucket": pa.array([b], pa.int64())})

    found = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits)).groupBy("bucket").applyInArrow(gather, "bucket long")
    return folder, bits, {r["bucket"] for r in found.collect()}, len(values)
