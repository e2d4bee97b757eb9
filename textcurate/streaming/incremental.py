"""Incremental curation with Structured Streaming: an extension of the resumable batch loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import cache as C


def dedup_stream(posts: DataFrame, delay: str = "7 days", time: str = "date", text: str = "text") -> DataFrame:
    """Posts whose normalised text wasn't seen within the delay; state older than the watermark is dropped."""
    marked = posts.withWatermark(time, delay).withColumn("group_id", T.text_hash(F.col(text)))
    return marked.dropDuplicatesWithinWatermark(["group_id"])


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows of each window and group, late rows within the delay included."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))


def upsert_stream(rows: DataFrame, cache_path: str, checkpoint: str, keys: list[str], process: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Run `process` on rows whose key the Parquet cache lacks and append the results, micro-batch by micro-batch.

    A batch that is run again finds its keys in the cache and adds nothing.
    """
    from pyspark.errors import AnalysisException

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            new = C.pending(new, spark.read.parquet(cache_path), keys)
        except AnalysisException:  # no cache yet
            pass
        (process(new) if process else new).write.mode("append").parquet(cache_path)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
