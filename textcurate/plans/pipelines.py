"""End-to-end plans: prepare a dataset, generate inputs, evaluate, report."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cost
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import generation as G
from ..operators import posts as P
from ..operators import sampling as S
from ..sources import readers, writers


def resolve_limit(given: int | None, configured: int | dict[str, int] | None = None, default: int | None = None, style_type: str | None = None) -> int | None:
    """The first limit that is set (given, configured for the style type or for all, default); one of 0 or less is an error."""
    if isinstance(configured, dict):
        configured = configured.get(style_type) if style_type else None
    for n in (given, configured, default):
        if n is not None:
            if n <= 0:
                raise ValueError("the limit must be positive")
            return n
    return None


def prepare(posts: DataFrame, style_type: str | None = None, min_chars: int = 50, max_samples: int | None = None, overrides: DataFrame | None = None, max_jaccard: float | None = None) -> DataFrame:
    """Processed records of posts: filter, deduplicate, keep recent, features, temporal split, brief, prompt.

    Without a style_type posts must have that column; every step then runs within each type.
    """
    rows = posts.withColumn("style_type", F.lit(style_type)) if style_type else posts
    rows = P.dedup_keep_earliest(P.filter_min_chars(rows, min_chars))
    if max_samples:
        rows = P.sample_recent(rows, max_samples, ["style_type"])
    rows = P.temporal_split(T.features(rows), ["style_type"])
    if overrides is not None:
        classified = P.classify_overrides(overrides.withColumn("__pos", F.monotonically_increasing_id()), max_jaccard)
        overrides = P.accepted_overrides(classified, "__pos")
    return P.build_records(rows, overrides)


def override_counts(records: DataFrame) -> DataFrame:
    """Records whose input came from an override, of each split and of all (split null)."""
    return records.rollup("split").agg(F.count_if(F.col("input_source") != "heuristic").alias("overrides"), F.count("*").alias("n"))


def generation_summary(records: DataFrame, model: str | None = None) -> DataFrame:
    """Quality, gates, usage and cost in one row."""
    q = E.quality_gate(E.summarize_quality(records.select("response_clean", "synthetic_failed", F.col("validation.*")), "synthetic_failed"))
    sums = (F.sum(F.col(f"usage.{c}")).alias(c) for c in ("usage_prompt_tokens", "usage_completion_tokens", "usage_total_tokens"))
    u = records.agg(*sums, F.round(F.sum("usage.cost_usd_estimate"), 6).alias("cost_usd_estimate"))
    return q.crossJoin(u)  # one row each


def dataset_summaries(records: DataFrame, model: str | None = None, failed: str = "synthetic_failed") -> DataFrame:
    """Quality, gates, usage and cost of the synthetic records of each path, style_type and split; estimated usage where a model is named."""
    by = ["style_type", "split", "path"]
    quality = E.quality_gate(E.summarize_quality(records, failed, by))
    spent = cost.summarize(records, model, bool(model), by)
    same = [quality[c].eqNullSafe(spent[c]) for c in by]
    return quality.join(spent, same).select(*(quality[c] for c in quality.columns), *(spent[c] for c in spent.columns if c not in by)).orderBy(*by)


def cost_table(records: DataFrame, model: str) -> DataFrame:
    """Estimated usage and cost of the records of each `path`, and a TOTAL row if there are several: one pass over them."""
    given = (("usage_prompt_tokens", "long"), ("usage_completion_tokens", "long"), ("cost_usd_estimate", "double"))
    rows = records.select("path", "response_clean", *(F.col(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in given))
    table = cost.summarize(rows, model, True, ["path"], rollup=True).withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row for each path
    named = F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("path"))
    out = table.where("__all = 0 or __n > 2").withColumn("path", named).withColumn("n_records", F.col("usage_actual_records") + F.col("usage_estimated_records"))
    return out.select("path", "n_records", "usage_prompt_tokens", "usage_completion_tokens", "usage_total_tokens", "usage_estimated_records", "cost_usd_estimate")


def evaluate(records: DataFrame, generated: DataFrame, classifier: E.StyleClassifier | None = None, encode: Callable | None = None, limit: int | None = None, model: str = "hashed trigrams") -> dict[str, Any]:
    """Lengths, style, similarity and distribution of generated texts (pos, text) against records (pos, input, response_clean, style_type); model names what `encode` is."""
    if limit:
        records, generated = P.prefix_limit(records, limit, "pos"), P.prefix_limit(generated, limit, "pos")
    rows = E.zip_by_position(records, generated.select("pos", F.col("text").alias("generated")))
    out: dict[str, Any] = {"length": E.length_stats(rows, "generated").first().asDict()}
    if classifier:
        place = F.array_position(F.array(*[F.lit(c) for c in classifier.classes]), F.col("style_type")).cast("int")
        said = classifier.predict(rows.where("generated is not null"), "generated").withColumn("own", F.element_at("probabilities", place))
        out["style"] = E.class_scores(said, "style_type", "predicted", "own").first().asDict()
        out["confusion"] = [r.asDict() for r in E.confusion(said, "style_type", "predicted", classifier.classes).collect()]
    out["cosine"] = E.cosine_scores(rows, "generated", "response_clean", encode)[1].first().asDict()
    both = E.embed(E.embed(rows, "generated", encode, "gv"), "response_clean", encode, "rv")
    out["mauve"] = E.mauve(both.select(F.col("gv").alias("embedding")), both.select(F.col("rv").alias("embedding")), model=model)
    return out


def load_or_build_manifest(spark: SparkSession, path: str, records: DataFrame, n_per_type: int, split: str = "val", seed: int = 42) -> DataFrame:
    """The pilot manifest saved at path; if there is none, a new one, saved if it has rows."""
    have = readers.read_optional_lines(spark, path)
    if have is not None:
        return have
    manifest = S.pilot_manifest(records, n_per_type, split, seed)
    if manifest.isEmpty():
        return manifest
    writers.write_jsonl(manifest, path)
    return readers.read_jsonl(spark, path, manifest.schema)


def pilot(spark: SparkSession, records: DataFrame, backend: Callable, n_per_type: int, seed: int = 42) -> DataFrame:
    """Two-pass briefs of the pilot manifest's rows."""
    return G.two_pass_brief(S.pilot_manifest(records, n_per_type, seed=seed), backend)
