"""Exact Jaccard join of documents over 5-word shingles by count vectors.

Shingles are hashed into fine groups, whose counts over the corpus put them into one order,
rare before frequent. Along that order the summed minima of two count vectors bound their
overlap: sets that link share a coordinate among the first fifth of either, as all others
together are too few. Coordinates that one set alone has can't be shared, so only the rest
of that fifth names cells in which a set is met: the tree's first level. A set with a fifth
of its shingles to itself is met nowhere, which is most of a corpus. Within cells, count
vectors over GROUPS groups prune pairs (an R-tree with summed minima) and surviving pairs
are verified on whole sets. See linking.classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .hashing import U, digest, shingle_sets
from .linking import SET_SCHEMA, classes, join_hot, set_batch, set_row, shared_cells
from .lookup import KEY_BITS, MASK, SharedKeys, Values, count_keys, write_values
from .runtime import lean, materialize

WIDTH = 5


def row_key() -> Column:
    """A hash of a row's doc_id and text, the same for equal rows alone."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def classed_rows(documents: DataFrame, width: int = WIDTH, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, doc, n, least, first) for every row of documents, in any order.

    doc is the row_key, n the size of the set, least the smallest doc_id of the row's class and
    first the row_key of the class's first row by (doc_id, row_key), null ids coming last. Rows
    without shingles have neither.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("doc"), text.alias("text"))
    # a group is a shingle's leading bits, which is what is compared when keys are counted
    folder, sizes = count_keys(texts.select("text"), lambda batches: (s for b in batches for _, s in shingle_sets(b.column(0), width)))

    def coordinates(batches):
        groups = SharedKeys(folder, sizes)
        for b in batches:
            ids, n, cells, held, size = [], [], [], [], 0
            doc = 0

            def flush():
                if not held:
                    return
                keys = np.concatenate(held) & MASK
                times = groups.times(keys)
                at = 0
                for s in held:
                    k, c = keys[at : at + len(s)], times[at : at + len(s)]
                    at += len(s)
                    first = len(s) - (len(s) * num + den - 1) // den + 1 if len(s) else 0
                    rest = first - int(np.count_nonzero(c == 1))  # coordinates of its own come first
                    if rest > 0:
                        shared = np.flatnonzero(c > 1)
                        own = shared[np.lexsort((k[shared], c[shared]))[:rest]]
                        cells.append((k[own] >> U(64 - KEY_BITS)).astype(np.int64))
                    else:
                        cells.append(np.empty(0, np.int64))
                held.clear()

            def batch():
                return pa.RecordBatch.from_arrays(
                    [b.column(0).slice(doc, len(n)), b.column(1).slice(doc, len(n)), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(cells, pa.list_(pa.int64()))],
                    names=["doc_id", "doc", "n", "id", "cells"],
                )

            for _, s in shingle_sets(b.column(2), width):
                n.append(len(s))
                ids.append(digest(s) if len(s) else None)
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    flush()
                    yield batch()
                    doc += len(n)
                    ids, n, cells, size = [], [], [], 0
            flush()
            yield batch()

    table = materialize(texts.mapInArrow(lean(coordinates), "doc_id long, doc long, n long, id long, cells array<long>"), "coordinates")
    rows = table.select("doc_id", "doc", "n", "id")
    members = shared_cells(table.select(F.explode("cells").alias("cell"), "id"))
    wanted = rows.where("id is not null").groupBy("id").agg(F.min("doc").alias("key")).join(members.select("id").distinct(), "id", "left_semi")
    wanted = write_values(wanted.select("key", F.lit(0).cast("long").alias("value")), "wanted")

    def build(batches):
        values = Values(wanted)
        for b in batches:
            out, size = [], 0
            own = [i for i, k in enumerate(b.column(1).to_pylist()) if values.get(k) is not None]
            for _, s in shingle_sets(b.column(2).take(pa.array(own, pa.int64())), width):
                out.append((digest(s), *set_row(s)))
                size += len(s)
                if size > 1 << 18:
                    yield set_batch(out)
                    out, size = [], 0
            if out:
                yield set_batch(out)

    # equal rows give equal sets, and nothing else does
    sets = materialize(texts.mapInArrow(lean(build), SET_SCHEMA).dropDuplicates(["id"]), "sets")
    found = classes(members, sets, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "doc"))
    each = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("rows"), first.alias("first"))
    each = materialize(each.join(found, each["id"] == found["node"], "left").select("id", "rows", "first", F.coalesce("component", "id").alias("class")), "each")
    of = each.groupBy("class").agg(F.count("*").alias("times"), F.min("first").alias("first"))
    each = join_hot(each.drop("first"), of, "class", "classes").select("id", F.col("rows").alias("times"), F.col("first.doc_id").alias("least"), F.col("first.doc").alias("first"))
    none = F.lit(None).cast("long")
    out = join_hot(rows.where("id is not null"), each, "id", "ids").drop("id")
    return out.unionByName(rows.where("id is null").drop("id").withColumns({"least": none, "first": none}))


def classes_of(documents: DataFrame, width: int = WIDTH, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents.

    component_id is the smallest doc_id that links reach. Null, empty and blank texts have
    no shingles and link with nothing; a text of fewer words is one shingle. Repeated rows
    keep their own rows; null ids stay null but link others. Further columns are ignored.
    """
    rows = classed_rows(documents, width, num, den)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def drop_near_copies(documents: DataFrame, width: int = WIDTH, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of documents that come first in their class (see classed_rows), columns as they are.

    Of equal rows one stays. Rows without shingles all stay. Rows are filtered where they are
    read: texts are shuffled of repeated rows alone.
    """
    rows = classed_rows(documents, width, num, den).where("first is not null")
    counted = materialize(rows.groupBy("doc").agg(F.count("*").alias("times"), F.max(F.col("doc") != F.col("first")).alias("goes")).where("goes or times > 1"), "copies")
    marks = write_values(counted.select(F.col("doc").alias("key"), F.when(F.col("goes"), 0).otherwise(1).cast("long").alias("value")), "copies")

    def mark(batches):
        values = Values(marks)
        for b in batches:
            own = [values.get(k) for k in b.column(b.num_columns - 1).to_pylist()]
            kind = np.array([2 if x is None else int(x[0]) for x in own], np.int64)
            keep = pa.array(np.flatnonzero(kind > 0))
            yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in b.columns), pa.array(kind[kind > 0])], names=[*b.schema.names, "__kind"])

    keyed = documents.withColumn("__key", row_key())
    marked = keyed.mapInArrow(lean(mark), StructType([*keyed.schema.fields, StructField("__kind", LongType())]))
    if counted.where("times > 1 and not goes").isEmpty():
        return marked.select(*documents.columns)
    marked = materialize(marked, "kept")
    return marked.where("__kind = 2").unionByName(marked.where("__kind = 1").dropDuplicates(["__key"])).select(*documents.columns)
