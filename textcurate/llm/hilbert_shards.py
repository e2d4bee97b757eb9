"""Sharding along a Hilbert curve over metadata dimensions.

Language, source and text size are quantised in their own order, the cell's index on the
Hilbert curve is computed per row (numpy, Arrow batches), rows are range-sorted by it and the
order is cut into equally long runs, so each shard covers a compact box of the metadata space
and a reader can skip shards by the minima and maxima of any of the dimensions. With 24 shards
over three dimensions a lookup of one value still reads about a third to a half of them, one of
two values at once far fewer (measured in the tests).
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .runtime import lean, materialize

BITS = 10
#: Distinct values of a category that its steps are cut from: those whose hashes are smallest, all if they are fewer.
VALUES = 20 << BITS


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of an (n, dims) array of cells below 2**bits."""
    x = [coords[:, i].astype(np.int64) for i in range(coords.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the curve's rotations, from the largest cube inwards
        q = 1 << level
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] & (1 << level)) != 0, t ^ ((1 << level) - 1), t)
    out = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> bit) & 1)
    return out


def hilbert_order(df: DataFrame, cells: list, tie_break: list[str], bits: int = BITS) -> DataFrame:
    """df with `hilbert` (curve index of the cell columns) and `rank`, its gapless position from 0.

    Rows are range-partitioned by (hilbert, tie_break), numbered inside each partition and
    offset by the partitions' counts; only those counts (one number a partition) reach the
    driver. A crowded cell splits between partitions, as the tie-break is part of the range key.
    """

    @F.pandas_udf("long")
    def curve(c: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(c.to_numpy(dtype=np.int64), bits))

    cell = F.struct(*[F.coalesce(c, F.lit(0)).cast("int").alias(f"c{i}") for i, c in enumerate(cells)])
    keyed = df.withColumn("hilbert", curve(cell))
    order = ["hilbert", *tie_break]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*ranged.schema.fields, StructField("part", IntegerType()), StructField("local", LongType())])

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))],
                names=[*b.schema.names, "part", "local"],
            )
            at += n

    table = materialize(ranged.mapInArrow(lean(number), schema), "hilbert")
    counts = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    spark = df.sparkSession
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, start long"))  # one row a partition
    return table.join(starts, "part").withColumn("rank", F.col("start") + F.col("local")).withColumn("total", F.lit(total).cast("long")).drop("start", "local", "part")


def ordered_cell(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Cell of a category in the order of its values, which are spread evenly over the cells; null is cell 0.

    The steps between cells are at most 2**bits - 2 values, cut from at most VALUES distinct
    ones; a value between two steps shares the lower one's cell, so the order always holds.
    """
    some = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(VALUES)
    values = sorted(r["v"].encode() for r in some.collect())
    cells = (1 << bits) - 2
    first = np.unique(np.ceil(np.arange(cells) * max(len(values) / cells, 1)).astype(int))
    steps = [values[i] for i in first if i < len(values)]
    spread = cells // max(len(steps), 1)

    @F.pandas_udf("int")
    def cell(values: pd.Series) -> pd.Series:
        known = {v: 0 if v is None else 1 + bisect_right(steps, v.encode()) * spread for v in values.unique()}
        return values.map(known).fillna(0).astype("int32")

    return cell(F.col(column).cast("string"))


def size_cell(column, bits: int = BITS):
    """Cell of a size: 32 steps to each doubling, at most the last cell."""
    return F.least(F.floor(F.log2(F.greatest(column, F.lit(1)).cast("double")) * 32), F.lit((1 << bits) - 1))


def _cells(documents: DataFrame, size: Column) -> list[Column]:
    return [ordered_cell(documents, "lang"), ordered_cell(documents, "source"), size_cell(size)]


def _placed(rows: DataFrame, cells: list, tie_break: list[str], shards: int) -> DataFrame:
    """rows with hilbert, shard (runs of equal row counts) and slot (gapless from 0 within a shard)."""
    ranked = hilbert_order(rows, cells, tie_break)
    first = F.expr(f"(cast(shard as long) * total + {shards - 1}) div {shards}")
    out = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    return out.withColumn("slot", (F.col("rank") - first).cast("long")).drop("rank", "total")


def shard(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert: law `rows`.

    Counts of two shards differ by one at most. Null text: no bytes, the CRC of no bytes.
    Null lang or source: cell 0. Repeated rows and ties of every column get neighbouring
    ranks. An empty table gives no rows. Further columns of the input are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + 8).cast("long")
    cells = [c.alias(f"cell{i}") for i, c in enumerate(_cells(documents, size))]
    rows = documents.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), *cells)
    placed = _placed(rows, [F.col(f"cell{i}") for i in range(len(cells))], ["doc_id", "text_crc32", "size"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(documents: DataFrame, path: str, shards: int = 24) -> DataFrame:
    """Write documents as a table with a folder for each shard; (shard, rows, least and greatest lang, source and size) of each.

    The same shards as shard() gives; the columns of documents stay, hilbert, shard and slot come on top.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size, own = (F.octet_length(text) + 8).cast("long"), [F.col(c) for c in documents.columns]
    rows = documents.select(F.struct(*own).alias("row"), "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), *(c.alias(f"cell{i}") for i, c in enumerate(_cells(documents, size))))
    placed = _placed(rows, [F.col(f"cell{i}") for i in range(3)], ["doc_id", "text_crc32", "size"], shards)
    placed.select("row.*", "hilbert", "shard", "slot").write.partitionBy("shard").parquet(path)
    ends = [f(c).alias(f"{name}_{c.split('.')[-1]}") for c in ("row.lang", "row.source", "size") for name, f in (("least", F.min), ("greatest", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *ends)
