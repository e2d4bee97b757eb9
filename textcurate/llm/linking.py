"""Links and classes of sets that meet in cells, without spelling out a cell's pairs.

`members` (cell, id) says which sets meet in which cells; every pair that may link must meet
in one. First each member is held against one pivot of its cell only, and verified links are
contracted to classes; this is repeated with other pivots while cells hold several classes,
PIVOTS times at most. Cells of very many rows are joined by broadcast (join_hot). Only cells that then still do are searched, by a
count-vector R-tree a cell, for pairs of different classes; pairs of small sets are verified
on the spot, and of links to one class one is enough, others are verified by a join. A cell
of more than BLOCK members is cut into blocks and each pair of blocks is a group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rtree import GROUPS, CountRTree, count_vector, may_link, overlap
from .runtime import connected_components, lean, materialize

BLOCK = 2048
#: Sets of up to so many members go to the searched cells whole (8 bytes a member) and are verified there.
WHOLE = 512
PIVOTS = 4
#: A key of more than one HOT-th of all rows is joined by broadcast; fewer than HOT keys can be.
HOT, LEAST_HOT = 1000, 1024
#: counts: of sets of more than WHOLE members; others' members give them as quickly.
SET_SCHEMA = "id long, n int, members binary, counts binary"


def set_row(values: np.ndarray) -> tuple[int, bytes, bytes | None]:
    return len(values), values.astype("<u8").tobytes(), count_vector(values).astype("<u4").tobytes() if len(values) > WHOLE else None


def set_batch(rows: list[tuple]) -> pa.RecordBatch:
    i, n, m, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(m, pa.binary()), pa.array(c, pa.binary())], names=["id", "n", "members", "counts"])


def join_hot(rows: DataFrame, of: DataFrame, key: str, name: str) -> DataFrame:
    """rows joined with `of`, which has each key once and `times`, the rows of that key.

    Rows of a key with more than a HOT-th of all rows (and LEAST_HOT) meet it by broadcast
    where they are, so that no task has to take them all; fewer than HOT keys are broadcast.
    """
    of = materialize(of, name, True)
    total, most = of.agg(F.sum("times"), F.max("times")).first()
    bound = max((total or 0) // HOT, LEAST_HOT)
    if not most or most <= bound:
        return rows.join(of.drop("times"), key)
    hot = F.broadcast(materialize(of.where(F.col("times") > bound).drop("times"), name + "-hot", True))
    others = rows.join(hot.select(key), key, "left_anti").join(of.where(F.col("times") <= bound).drop("times"), key)
    return rows.join(hot, key).unionByName(others)


def shared_cells(rows: DataFrame) -> DataFrame:
    """Distinct (cell, id, n) of the cells with n > 1 ids; of cells with the same ids only one stays."""
    met = materialize(rows.select("cell", "id").distinct(), "cells")
    who = met.groupBy("cell").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.min("id").alias("lo")).where("n > 1")
    kept = who.groupBy("n", "x", "lo").agg(F.min("cell").alias("cell")).select("cell", "n", F.col("n").alias("times"))
    return materialize(join_hot(met, kept, "cell", "shared"), "cells")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b, ka, kb) whose sets a and b have a Jaccard similarity of num/den or more."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"), F.col("counts").alias("ca"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"), F.col("counts").alias("cb"))
    joined = pairs.join(one, "a").join(two, "b").where(f"{den}L * least(na, nb) >= {num}L * greatest(na, nb)")

    def check(batches):
        for t in batches:
            keep = []
            for i, (ma, mb, ca, cb) in enumerate(zip(t["ma"].to_pylist(), t["mb"].to_pylist(), t["ca"].to_pylist(), t["cb"].to_pylist())):
                x, y = np.frombuffer(ma, "<u8"), np.frombuffer(mb, "<u8")
                if ca is not None and cb is not None:
                    most = np.minimum(np.frombuffer(ca, "<u4"), np.frombuffer(cb, "<u4")).sum()
                    if not may_link(most, np.int64(len(x)), np.int64(len(y)), num, den):
                        continue
                if may_link(np.int64(overlap(x, y)), np.int64(len(x)), np.int64(len(y)), num, den):
                    keep.append(i)
            yield t.select(["a", "b", "ka", "kb"]).take(pa.array(keep, pa.int64()))

    return joined.select("a", "b", "ka", "kb", "ma", "mb", "ca", "cb").mapInArrow(lean(check), "a long, b long, ka long, kb long")


def merged(found: DataFrame | None, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, new class) of the classes ka and kb that links join, (node, component) of all ids in a class with another)."""
    new = materialize(connected_components(links.select(F.col("ka").alias("a"), F.col("kb").alias("b"))), "merges", True)
    if found is None:
        return new, new
    step = new.select(F.col("node").alias("old"), F.col("component").alias("to"))
    moved = found.join(step, found["component"] == F.col("old"), "left").select("node", F.coalesce("to", "component").alias("component"))
    return new, materialize(moved.unionByName(new.join(found.select("node"), "node", "left_anti")), "found", True)


def classes(members: DataFrame, sets: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(node, component) of the ids that link with another; members has (cell, id, n), n being the cell's size."""
    known = members.select("cell", "id", "n", F.col("id").alias("class"))
    found = None
    for turn in range(PIVOTS):
        # the pivot of a cell: the member of the smallest hash, another one each turn
        pivot = F.min_by(F.struct(F.col("id").alias("p_id"), F.col("class").alias("p_class")), F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id")).alias("p")
        heads = known.groupBy("cell").agg(pivot, F.count("*").alias("times")).select("cell", "times", "p.*")
        apart = join_hot(known, heads, "cell", "pivots").where("class <> p_class")
        stars = apart.select(F.col("p_id").alias("a"), F.col("id").alias("b"), F.col("p_class").alias("ka"), F.col("class").alias("kb")).distinct()
        links = materialize(verified(stars, sets, num, den), "links", True)
        if not links.isEmpty():
            new, found = merged(found, links)
            known = known.join(new, known["class"] == new["node"], "left").select("cell", "id", "n", F.coalesce("component", "class").alias("class"))
        open_cells = known.groupBy("cell").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("times")).where("lo <> hi").select("cell", "times")
        known = materialize(join_hot(known, open_cells, "cell", "open-cells"), "open", True)
        if known.isEmpty():
            return found if found is not None else _nothing(members)
    rest = known
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rest = rest.withColumn("blocks", blocks).withColumn("own", own)
    # block i meets block j in group (i, j), i <= j
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "class")
    points = sets.select("id", F.col("n").alias("size"), "counts", F.when(F.col("n") <= WHOLE, F.col("members")).alias("members"))
    rest = rest.join(points, "id")

    def search(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        ids, cls, own = (t[c].to_numpy() for c in ("id", "class", "own"))
        sizes = t["size"].to_numpy().astype(np.int64)
        whole = [None if x is None else np.frombuffer(x, "<u8") for x in t["members"].to_pylist()]
        vectors = np.zeros((len(ids), GROUPS), np.int32)
        for k, (m, c) in enumerate(zip(whole, t["counts"].to_pylist())):
            vectors[k] = np.frombuffer(c, "<u4") if m is None else count_vector(m)
        tree_rows = np.flatnonzero(own == j)
        tree = CountRTree(vectors[tree_rows], sizes[tree_rows])
        a, b = [], []
        for q in np.flatnonzero(own == i):
            hit = tree_rows[tree.search(vectors[q], int(sizes[q]), num, den)]
            hit = hit[(cls[hit] != cls[q]) & ((ids[hit] > ids[q]) | (i != j))]
            keep, met = [], set()
            for k in hit.tolist():
                if whole[q] is None or whole[k] is None:
                    keep.append(k)
                elif cls[k] not in met and may_link(np.int64(overlap(whole[q], whole[k])), np.int64(sizes[q]), np.int64(sizes[k]), num, den):
                    met.add(cls[k])
                    keep.append(k)
            a += [q] * len(keep)
            b += keep
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": ids[a], "b": ids[b], "ka": cls[a], "kb": cls[b]})

    pair = "a long, b long, ka long, kb long"
    pairs = rest.groupBy("cell", "i", "j").applyInArrow(search, pair)
    one = F.col("a") < F.col("b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(one, F.col("ka")).otherwise(F.col("kb")).alias("ka"), F.when(one, F.col("kb")).otherwise(F.col("ka")).alias("kb"))
    more = materialize(pairs.distinct(), "pairs", True)
    links = materialize(verified(more, sets, num, den), "links", True)
    if links.isEmpty():
        return found if found is not None else _nothing(members)
    return merged(found, links)[1]


def _nothing(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], "node long, component long")
