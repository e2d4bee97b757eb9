"""Result caches: last-wins loads, pending rows, upserts, early stop, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, found by one aggregation with map-side combining."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(row).select("r.*")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    row = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(row).select("r.*")


def pending(records: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Records without a cached result."""
    return records.join(cache.select(*keys).distinct(), keys, "left_anti")


def upsert(cache: DataFrame, new: DataFrame, keys: list[str], version: str = "__version") -> DataFrame:
    """The cache with new rows in place of those of equal key."""
    both = cache.withColumn(version, F.lit(0)).unionByName(new.withColumn(version, F.lit(1)), allowMissingColumns=True)
    return last_wins(both, keys, [version]).drop(version)


def reassemble(records: DataFrame, cache: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Cached rows of the records, in the records' order."""
    return records.select(*keys, position).join(cache, keys).orderBy(position)


def relabel(cache: DataFrame, method: str) -> DataFrame:
    """Cached rows that are ok carry `{method}_synthetic` as their source."""
    name = f"{method}_synthetic"
    return cache.withColumn("input_source", F.when(F.col("synthetic_ok") & ~F.col("input_source").eqNullSafe(F.lit(name)), name).otherwise(F.col("input_source")))


def until_target(df: DataFrame, ok: Column, order: list[Column], target: int, chunk: int, by: list[str] | None = None) -> DataFrame:
    """Rows up to the end of the first chunk (of `chunk` rows in order) after which `target` rows are ok.

    Positions and running counts are added up across tasks, so a group is no single task's work.
    """
    from .posts import join_small, ranks

    by = by or []
    placed = ranks(df, by, order, "__n", {"__done": F.coalesce(ok.cast("int"), F.lit(0))}).drop("total")
    placed = placed.withColumn("chunk", F.floor((F.col("__n") - 1) / chunk).cast("int"))
    stops = placed.groupBy(*by).agg(F.min(F.when(F.col("__done") >= target, F.col("chunk"))).alias("__stop"))
    out = join_small(placed, stops, by)
    return out.where(F.col("__stop").isNull() | (F.col("chunk") <= F.col("__stop"))).drop("__n", "__done", "__stop")


def best_attempt(attempts: Column) -> Column:
    """Of an array of attempt structs: the first that didn't fail, else the last."""
    good = F.filter(attempts, lambda a: ~a["failed"])
    return F.when(F.size(good) > 0, F.element_at(good, 1)).otherwise(F.try_element_at(attempts, F.lit(-1)))


def rollup_attempts(attempts: Column, primary: str | Column) -> Column:
    """Struct of summed tokens and cost, number of attempts and whether another model answered."""
    total = lambda f: F.aggregate(attempts, F.lit(0).cast("long"), lambda acc, a: acc + F.coalesce(a[f], F.lit(0)))
    cost = F.aggregate(attempts, F.lit(0.0), lambda acc, a: acc + F.coalesce(a["cost_usd_estimate"], F.lit(0.0)))
    primary = F.lit(primary) if isinstance(primary, str) else primary
    return F.struct(
        total("usage_prompt_tokens").alias("usage_prompt_tokens"), total("usage_completion_tokens").alias("usage_completion_tokens"), total("usage_total_tokens").alias("usage_total_tokens"),
        F.round(cost, 6).alias("cost_usd_estimate"), F.size(attempts).alias("attempts"), F.exists(attempts, lambda a: a["model"] != primary).alias("used_fallback"),
    )
