"""Shared-folder tables, DataFrame plumbing and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (local tests) is a folder of our own set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="textcurate-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of an Arrow batch between Spark and its Python workers; texts of documents make thousands of them large.
BATCH_ROWS = "2048"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set BATCH_ROWS for the session, unless the cluster's or the session's own setting differs from Spark's default."""
    if spark.conf.get(_ROWS) == "10000" and not spark.sparkContext.getConf().contains(_ROWS):
        spark.conf.set(_ROWS, BATCH_ROWS)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over a task's batches; at the end the worker gives the memory it has freed back to the system."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release()

    return run


def release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library frees by itself
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Folders of applications that are deleted with them.
_owned: set[str] = set()
#: Paths that the open `temporary` blocks will delete.
_made: list[list[str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of the application that goes when it ends."""
    small_batches(spark)
    own = f"{shared_dir(spark)}/textcurate/{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        there = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = there.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(there)
        store.deleteOnExit(there)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes what was written by work_dir inside the block, once the block's results are written elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder, if it is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    small: a table of few rows for its input; it gets four files a core at most.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    schema = df.schema
    if small:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(path: str) -> str:
    """The path that workers open: a file: URL without its scheme."""
    return path[len("file://"):] if path.startswith("file://") else path.removeprefix("file:")


def ascii_lower(column):
    return F.translate(column, UPPER, UPPER.lower())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (a long, b long); component is the smallest node.

    Each round hooks every component on its smallest neighbour, shortcuts the pointers
    until they are stable and contracts the edges, all as DataFrame joins on tables in
    the shared folder. Self links, repeated links and an empty table are allowed.
    """
    both = edges.select("a", "b").where("a is not null and b is not null")
    live = materialize(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges", True)
    labels = both.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not live.isEmpty():
        parent = materialize(live.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("p")), "cc-parent", True)
        while True:
            one, two = (parent.select(F.col("c").alias(f"c{k}"), F.col("p").alias(f"p{k}")) for k in (1, 2))
            if parent.join(one, F.col("p") == F.col("c1"), "left_semi").isEmpty():
                break
            far = parent.join(one, F.col("p") == F.col("c1"), "left").join(two, F.col("p1") == F.col("c2"), "left")
            parent = materialize(far.select("c", F.coalesce("p2", "p1", "p").alias("p")), "cc-parent", True)
        labels = materialize(
            labels.join(parent, labels.component == parent.c, "left").select("node", F.coalesce("p", "component").alias("component")), "cc-labels", True
        )
        pa = parent.select(F.col("c").alias("a"), F.col("p").alias("pa"))
        pb = parent.select(F.col("c").alias("b"), F.col("p").alias("pb"))
        moved = live.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        live = materialize(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges", True)
    return labels
