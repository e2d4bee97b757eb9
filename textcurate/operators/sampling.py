"""Reproducible stratified samples. Shuffles are orders by md5(seed:key), the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import checkpointed
from .posts import SMALL, join_small
from .quantiles import summaries


def shuffle_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys]))


def _title(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def add_strata(df: DataFrame, by: list[str] | None = None, text: str = "response_clean") -> DataFrame:
    """df with has_numbers, char_len_q (quartile of char_len), multi_para and stratum.

    Quartile edges are exact percentiles of each group, one small row each, joined back;
    equal edges leave quartiles empty instead of failing.
    """
    by = by or []
    edges = summaries(df, {"__e": ("char_len", [0.25, 0.5, 0.75])}, by).select(*by, F.col("__e.q").alias("__e"))
    out = join_small(df, edges, by)
    n, e = F.col("char_len"), F.col("__e")
    q = F.when(n <= e[0], "Q1").when(n <= e[1], "Q2").when(n <= e[2], "Q3").otherwise("Q4")
    out = out.withColumns({"has_numbers": F.rlike(F.col(text), F.lit(r"\p{Nd}")), "char_len_q": q, "multi_para": F.col("n_paragraphs") >= 2})
    return out.withColumn("stratum", F.concat_ws("_", "char_len_q", _title(F.col("multi_para")), _title(F.col("has_numbers")), _title(F.col("has_emoji")))).drop("__e")


def proportions(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = df.groupBy(*by, "stratum").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def _quota_rows(df: DataFrame, n: int, seed: int, by: list[str], key: str) -> DataFrame:
    """Key, group and stratum of the n first rows of each stratum in shuffle order, with rank, quota and size of the stratum.

    A sample takes a row only with all rows of its stratum that come before it, so no row
    beyond the n-th is ever taken; the filter lets each task keep n rows of a stratum. Texts
    stay where they are: only these columns are written, once, and shuffled.
    """
    marked = checkpointed(df.select(*by, "stratum", key).withColumn("__k", shuffle_key(seed, key)))
    quota = F.greatest(F.lit(1), F.bround(F.col("share") * n).cast("int")).alias("__quota")
    shares = proportions(marked, by).select(*by, "stratum", quota, F.col("n").alias("__size"))
    w = Window.partitionBy(*by, "stratum").orderBy("__k", key)
    return join_small(marked.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n), shares, [*by, "stratum"])


def _chosen(df: DataFrame, chosen: DataFrame, by: list[str], key: str) -> DataFrame:
    """The rows of df whose group and key are chosen: at most n of a group, sent to where the rows are if they are few."""
    chosen = checkpointed(chosen.select(*by, key))
    return df.join(F.broadcast(chosen) if chosen.count() <= SMALL else chosen, [*by, key], "left_semi")


def stratified_sample(df: DataFrame, n: int, seed: int = 42, by: list[str] | None = None, key: str = "post_id") -> DataFrame:
    """n rows of each group (all if fewer): strata by share, at least one each, topped up in shuffle order. Keys are unique in their group."""
    by = by or []
    rows = _quota_rows(df, n, seed, by, key)
    first = F.when(F.col("__r") <= F.col("__quota"), 0).otherwise(1)
    order = F.row_number().over(Window.partitionBy(*by).orderBy("__first", "__k", key))
    return _chosen(df, rows.withColumn("__first", first).withColumn("__n", order).where(F.col("__n") <= n), by, key)


def stratified_sample_no_topup(df: DataFrame, n: int, seed: int = 42, by: list[str] | None = None, key: str = "post_id") -> DataFrame:
    """Quota rows only, frequent strata first, distinct, at most n of each group. Keys are unique in their group."""
    by = by or []
    rows = _quota_rows(df, n, seed, by, key).where(F.col("__r") <= F.col("__quota"))
    w = Window.partitionBy(*by).orderBy(F.desc("__size"), "stratum", "__k", key)
    return _chosen(df, rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n), by, key).distinct()


def pilot_manifest(records: DataFrame, n_per_type: int, split: str = "val", seed: int = 42, source_file: Column | None = None, created_at: Column | None = None) -> DataFrame:
    """The sample of each style type in the manifest's 18 columns."""
    rows = add_strata(records.where(F.col("split") == split), ["style_type"])
    group = F.col("group_id") if "group_id" in records.columns else F.lit(None).cast("string")
    out = stratified_sample(rows.withColumn("group_id", F.coalesce(group, T.text_hash(F.col("response_clean")))), n_per_type, seed, ["style_type"])
    return out.select(
        F.concat_ws(":", "style_type", "post_id").alias("pilot_id"), "post_id", "group_id", "style_type", "split", F.lit(split).alias("source_split"),
        (source_file if source_file is not None else F.concat(F.col("style_type"), F.lit(f"_{split}.jsonl"))).alias("source_file"), "date", "response_clean", "char_len", "n_paragraphs",
        "has_emoji", "has_numbers", "char_len_q", "multi_para", "stratum", F.lit(seed).alias("manifest_seed"),
        (created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("manifest_created_at"),
    )
