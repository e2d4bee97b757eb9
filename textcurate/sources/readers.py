"""Readers: message exports, JSON lines, text lists, generated blocks, caches, optional artefacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import last_wins
from . import exports

BLOCK = "\n===\n"


def flatten_text(v: Column) -> Column:
    """Text of a VARIANT that is a string or a list of strings and {text}; other parts count as nothing."""
    part = lambda f: F.when(F.schema_of_variant(f) == "STRING", F.try_variant_get(f, "$", "string")).otherwise(F.coalesce(F.try_variant_get(f, "$.text", "string"), F.lit("")))
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(v.isNull(), "").when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(F.array_join(F.transform(items, part), ""), F.lit("")))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """posts (post_id, date, text, channel) of JSON exports: one document a file, its `messages` of type message.

    Files are read in splits, whatever their size (exports.py). A document without a name is
    called after its folder. Messages without a text have an empty one; a date that can't be
    read is null. A document that ends too early raises ValueError.
    """
    each = exports.messages(spark, path)
    return posts_of(each.select(_channel(F.col("name"), F.col("file")).alias("channel"), F.parse_json("value").alias("m")))


def parse_export(documents: DataFrame) -> DataFrame:
    """read_export of documents that are rows already (value: JSON of 128 MB at most, file: path)."""
    docs = documents.select(F.parse_json("value").alias("v"), F.col("file").alias("f"))
    docs = docs.select("v", _channel(F.try_variant_get("v", "$.name", "string"), F.col("f")).alias("channel"))
    return posts_of(docs.select("channel", F.explode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("m")))


def _channel(name: Column, file: Column) -> Column:
    return F.coalesce(name, F.try_element_at(F.split(file, "/"), F.lit(-2)))


def posts_of(messages: DataFrame) -> DataFrame:
    """posts of the messages (channel, m: VARIANT) of type message."""
    kept = messages.where(F.try_variant_get("m", "$.type", "string") == "message")
    date = F.try_variant_get("m", "$.date", "string")
    return kept.select(
        F.try_variant_get("m", "$.id", "long").alias("post_id"), F.try_to_timestamp(date).alias("date"), flatten_text(F.try_variant_get("m", "$.text", "variant")).alias("text"), "channel"
    )


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def ordered(spark: SparkSession, path: str, separator: str | None = None, body: Callable[[Column], Column] = lambda c: c, keep: Callable[[Column], Column] = lambda c: c.isNotNull()) -> DataFrame:
    """(pos, text): body(record) of the records that `keep` holds for, numbered from 0 in their order over all files.

    Files are read in splits, by line or by another separator. A first pass counts what each
    split keeps; positions are counts of earlier splits (files by name, splits by place) plus the
    place in the split, so no task sees more than its splits. The driver holds two numbers a split.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    where = ["file", "start"]
    rows = reader.text(path).select(body(F.col("value")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = rows.where(keep(F.col("text"))).withColumn("id", F.monotonically_increasing_id())  # ids follow the rows of a task without gaps
    splits = rows.groupBy(*where).agg(F.min("id").alias("low"), F.count("*").alias("n")).collect()
    before, shift = 0, []
    for r in sorted(splits, key=lambda r: (r["file"], r["start"])):
        shift.append((r["file"], r["start"], before - r["low"]))
        before += r["n"]
    known = F.broadcast(spark.createDataFrame(shift, "file string, start long, shift long"))
    return rows.join(known, where).select((F.col("id") + F.col("shift")).alias("pos"), "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text) of the lines that aren't blank, in order."""
    return ordered(spark, path, keep=lambda c: F.trim(c) != "")


def read_field(spark: SparkSession, path: str, field: str) -> DataFrame:
    return spark.read.json(path).select(field)


def read_blocks(spark: SparkSession, path: str) -> DataFrame | None:
    """(pos, text) of the stripped, non-empty blocks between separator lines; None if the file is missing or has none.

    Where a separator line follows another, a file of several splits may be cut at either.
    """
    from ..functions.text import strip

    try:
        out = ordered(spark, path, BLOCK, strip, lambda c: c != "")
    except AnalysisException:
        return None
    return None if out.isEmpty() else out


def read_split(spark: SparkSession, base: str, style_type: str, split: str) -> DataFrame | None:
    """A partition of a table laid out by style_type and split; None if it isn't there."""
    try:
        return spark.read.option("basePath", base).json(f"{base}/style_type={style_type}/split={split}")
    except AnalysisException:
        return None


def read_optional(spark: SparkSession, path: str, kind: str = "json") -> DataFrame | None:
    try:
        reader = spark.read.option("multiLine", True)
        return reader.json(path) if kind == "json" else reader.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)
    except AnalysisException:
        return None


def read_optional_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """read_jsonl, or None if the file isn't there."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException:
        return None


def read_present(spark: SparkSession, paths: list[str], schema: str | None = None) -> dict[str, DataFrame]:
    """The JSON-lines files that are there and have rows, by path."""
    found = {p: read_optional_lines(spark, p, schema) for p in paths}
    return {p: df for p, df in found.items() if df is not None and not df.isEmpty()}


def read_caches(spark: SparkSession, paths: list[str], keys: list[str], schema: str | None = None) -> DataFrame | None:
    """Cached rows of several JSON-lines files: of equal keys the later file's, then the later line's."""
    parts = []
    for rank, path in enumerate(paths):
        try:
            rows = read_jsonl(spark, path, schema)
            parts.append(rows.select("*", F.lit(rank).alias("__file"), F.monotonically_increasing_id().alias("__line")))
        except AnalysisException:
            continue
    if not parts:
        return None
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return last_wins(both, keys, ["__file", "__line"]).drop("__file", "__line")
