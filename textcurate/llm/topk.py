"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

A block of vectors is indexed as posting segments of descending quantised impact: the
segment of impact 2**s holds, for every dimension, the digit that a component has at that
impact (dense vectors have a posting in every list, so a segment is stored as a matrix).
Segments are processed from the highest impact down, for a group of queries at once. After
each, what lower impacts can still add bounds every row's score from both sides; rows whose
upper bound is below the k-th best lower bound, or below the k-th best score of earlier blocks,
are proven out. A query stops as soon as few possible members are left, and is at the end of
the segments in any case; what is left is rescored exactly.

Queries lie in files in the shared folder, which tasks over the vectors map: a task holds some
blocks of vectors, passes all queries over them and returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import map_array, save_array
from .runtime import lean, work_dir

BLOCK = 8192
#: Blocks that a task holds while it passes the queries over them.
HELD = 8
#: Queries whose accumulators (8 bytes a row of a block) are held at once.
GROUP = 64
#: Queries of a file, about.
FILE = 1 << 16
#: Segments of an index: the first takes the sign and 3 bits of the largest component, each further one 3 bits more.
SEGMENTS, FIRST, STEP = 3, 3, 3
#: So many times k rows left are rescored rather than bounded once more.
LEFT = 16


class ImpactIndex:
    """Index over an (n, dims) integer matrix; ids are those of its rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.segments, above, last = ids, values, [], None, 0
        bits = int(np.abs(values).max(initial=0)).bit_length()
        for s in (bits - FIRST - STEP * k for k in range(SEGMENTS)):
            if s >= 0:
                level = values >> s
                self.segments.append((s, (level if above is None else level - (above << (last - s))).astype(np.float64).T))
                above, last = level, s

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of the k best rows of each query but rows of id skip[i]; ties to the smaller id.

        Rows that score below least[i] may be left out. Sums that could reach 2**52, beyond which
        float products aren't exact, are left to the exact rescoring.
        """
        q = queries.astype(np.float64)
        live = self.ids[None, :] != skip[:, None]
        out: list = [None] * len(q)
        bound = np.abs(q).sum(1) * float(np.abs(self.values).max(initial=0))
        todo = np.flatnonzero(bound < 2.0**52)
        rows = np.arange(len(self.ids))
        done = np.zeros((len(q), len(rows)))
        for s, segment in self.segments:
            if not len(todo):
                break
            done += (q[todo] @ segment[:, rows]) * (1 << s)
            rest = (1 << s) - 1  # lower impacts add 0 to `rest` to a component
            low = np.where(live[todo][:, rows], done + rest * np.minimum(q[todo], 0).sum(1)[:, None], -np.inf)
            theta = least[todo].astype(np.float64)
            if len(rows) > k:
                theta = np.maximum(theta, np.partition(low, -k, axis=1)[:, -k])
            here = live[todo][:, rows] & (done + rest * np.maximum(q[todo], 0).sum(1)[:, None] >= theta[:, None])
            stays = here.sum(1) > LEFT * k
            for i, own in zip(todo[~stays], here[~stays]):
                out[i] = self.rescore(queries[i], rows[own], k)
            some = here[stays].any(0)
            live[np.ix_(todo[stays], rows)] = here[stays]
            todo, done, rows = todo[stays], done[stays][:, some], rows[some]
        for i, found in enumerate(out):
            if found is None:
                out[i] = self.rescore(queries[i], np.flatnonzero(live[i]), k)
        return out

    def rescore(self, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.values[rows] @ query
        keep = np.lexsort((self.ids[rows], -score))[:k]
        return score[keep], self.ids[rows[keep]]


def quantise(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component as long; null, null-holding or non-finite vectors drop."""
    x = F.col(vector)
    good = F.coalesce(~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(False))
    return df.where(good & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v")
    )


def write_queries(queries: DataFrame) -> tuple[str, list[tuple[int, int]]]:
    """Folder and (length, number) of the files of the (id, v) queries: ids and matrices of equal length."""
    folder = work_dir(queries.sparkSession, "queries")
    sized = queries.select("id", "v", F.size("v").alias("size"))
    rows = sized.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
    parts = F.lit(1)
    for r in rows:
        parts = F.when(F.col("size") == r["size"], -(-r["n"] // FILE)).otherwise(parts)

    def gather(t: pa.Table) -> pa.Table:
        size, part = t["size"][0].as_py(), t["part"][0].as_py()
        ids = t["id"].to_numpy()
        values = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), size)
        save_array(folder, f"ids-{size}-{part}.npy", ids)
        save_array(folder, f"values-{size}-{part}.npy", values)
        return pa.table({"size": pa.array([size], pa.int32()), "part": pa.array([part], pa.int64())})

    sized = sized.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("long"))
    found = sized.groupBy("size", "part").applyInArrow(gather, "size int, part long").collect()  # a row for each file
    return folder, sorted((r["size"], r["part"]) for r in found)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score over (id, v) tables; a query's own id is no candidate.

    Each task indexes its vectors by blocks and returns k rows a query, from which a window
    keeps the k best. Rows of another length than the query's don't match it. Scores are long
    integers. Empty tables give no rows; vectors of one id are rows of their own, and queries of
    one id share its k places.
    """
    spark = vectors.sparkSession
    folder, files = write_queries(queries)
    if not files:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lengths = {size for size, _ in files}

    def best(held: list[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[pa.RecordBatch]:
        indexes = [ImpactIndex(i, v) for i, v in held]
        for part in (p for s, p in files if s == size):
            qid, q = (np.asarray(map_array(folder, f"{name}-{size}-{part}.npy")) for name in ("ids", "values"))
            for at in range(0, len(qid), GROUP):
                ids, own = qid[at : at + GROUP], q[at : at + GROUP]
                found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
                for index in indexes:
                    least = np.array([s[-1] if len(s) == k else np.iinfo(np.int64).min for s, _ in found], np.int64)
                    for j, (s, w) in enumerate(index.search(own, k, ids, least)):
                        s, w = np.concatenate([found[j][0], s]), np.concatenate([found[j][1], w])
                        keep = np.lexsort((w, -s))[:k]
                        found[j] = s[keep], w[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, [len(s) for s, _ in found])), pa.array(np.concatenate([w for _, w in found])), pa.array(np.concatenate([s for s, _ in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {n: [] for n in lengths}
        blocks: dict[int, list] = {n: [] for n in lengths}

        def block(n):
            blocks[n].append(tuple(np.concatenate(x) for x in zip(*waiting[n])))
            waiting[n] = []

        for b in batches:
            v = b.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            flat, ids = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64), b.column(0).to_numpy()
            for n in lengths:
                fits = sizes == n
                m, own = flat[np.repeat(fits, sizes)].reshape(-1, n), ids[fits]
                for a in range(0, len(own), BLOCK):
                    waiting[n].append((own[a : a + BLOCK], m[a : a + BLOCK]))
                    if sum(len(i) for i, _ in waiting[n]) >= BLOCK:
                        block(n)
                    if len(blocks[n]) == HELD:
                        yield from best(blocks[n], n)
                        blocks[n] = []
        for n in lengths:
            if waiting[n]:
                block(n)
            if blocks[n]:
                yield from best(blocks[n], n)

    found = vectors.mapInArrow(lean(scan), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
