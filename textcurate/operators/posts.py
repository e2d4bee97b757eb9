"""Relational steps over posts: filter, deduplicate, keep recent, split, project, override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import overlap, prompts
from ..functions import text as T
from ..sources.files import checkpointed
from .quantiles import summaries


def filter_min_chars(df: DataFrame, min_chars: int = 50, text: str = "text") -> DataFrame:
    """Texts stripped, those of fewer characters and null ones dropped."""
    return df.withColumn(text, T.strip(F.col(text))).where(F.length(text) >= min_chars)


def dedup_keep_earliest(df: DataFrame, text: str = "text", time: str = "date", key: str = "post_id") -> DataFrame:
    """The earliest row (then smallest key) of each normalised text; rows without a time count last.

    One aggregation with map-side combining keeps the row of each text, so a text that holds a
    third of all rows costs a task no more than another, and each text is normalised once.
    """
    order = F.struct(F.col(time).isNull().alias("late"), F.col(time).alias("time"), F.col(key).alias("key"))
    kept = df.groupBy(T.text_hash(F.col(text)).alias("__h")).agg(F.min_by(F.struct(*df.columns), order).alias("__row"))
    return kept.select("__row.*")


def sample_recent(df: DataFrame, n: int, by: list[str] | None = None, time: str = "date", key: str = "post_id") -> DataFrame:
    """The n newest rows, of each group of `by`; undated rows are oldest, ties go to the larger key.

    Without groups this is a top-n sort; with groups the rank filter stops early inside each task.
    """
    order = [F.col(time).desc_nulls_last(), F.col(key).desc()]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


#: Rows of a side that may be sent to every task.
SMALL = 100_000


def join_small(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df joined with one row a key of `other`: by broadcast if it has SMALL rows at most, which is counted first."""
    other = checkpointed(other)  # read here, and again if it is joined
    rows = other.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        return df.join(other, keys)
    small = F.broadcast(df.sparkSession.createDataFrame(rows, other.schema))
    return df.join(small, keys) if keys else df.crossJoin(small)  # without keys it is one row


def ranks(df: DataFrame, by: list[str], order: list[str | Column], to: str = "rank", running: dict[str, Column] | None = None) -> DataFrame:
    """df with the row's gapless rank from 1 within its group, `total`, the group's rows, and running sums by name.

    A group is not sorted in one task: rows are range-partitioned by (by, order), numbered
    inside each partition and shifted by the counts (and sums) of the group's earlier partitions.
    Names in `order` ascend, nulls last.
    """
    running = running or {}
    sorts = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    valued = df.withColumns({f"__v_{k}": v for k, v in running.items()})
    ranged = valued.repartitionByRange(*[F.col(c) for c in by], *sorts).withColumn("__p", F.spark_partition_id())
    ranged = checkpointed(ranged)  # one partitioning for both branches, whatever executors are lost
    w = Window.partitionBy("__p", *by).orderBy(*sorts)
    sums = {f"__s_{k}": F.sum(f"__v_{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in running}
    local = ranged.withColumns({"__n": F.row_number().over(w), **sums})
    counts = ranged.groupBy("__p", *by).agg(F.count("*").alias("__c"), *(F.sum(f"__v_{k}").alias(f"__c_{k}") for k in running))
    w = Window.partitionBy(*by)
    before = w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {"__s": F.coalesce(F.sum("__c").over(before), F.lit(0)), **{f"__b_{k}": F.coalesce(F.sum(f"__c_{k}").over(before), F.lit(0)) for k in running}}
    shift = counts.withColumns({**earlier, "total": F.sum("__c").over(w)})
    same = [local[c].eqNullSafe(shift[c]) for c in ["__p", *by]]
    more = [(F.col(f"__s_{k}") + F.col(f"__b_{k}")).alias(k) for k in running]
    return local.join(shift, same).select(*[local[c] for c in df.columns], (F.col("__n") + F.col("__s")).alias(to), "total", *more)


def temporal_split(df: DataFrame, by: list[str] | None = None, time: str = "date", key: str = "post_id", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """df with `split`: by time within each group, the first share trains, the next validates, the rest tests.

    Ranks are counted across tasks, so a group that holds most rows is no single task's work.
    """
    ranked = ranks(df, by or [], [time, key], "__r")
    n, r = F.col("total"), F.col("__r")
    split = F.when(r <= F.floor(n * F.lit(train)), "train").when(r <= F.floor(n * F.lit(round(train + val, 10))), "val").otherwise("test")
    return ranked.withColumn("split", split).drop("__r", "total")


def split_report(df: DataFrame, by: str = "style_type", time: str = "date") -> DataFrame:
    """Rows of each split, all rows and the first and last time of each group."""
    count = lambda s: F.count_if(F.col("split") == s).alias(f"n_{s}")
    return df.groupBy(by).agg(count("train"), count("val"), count("test"), F.count("*").alias("total"), F.min(time).alias("first"), F.max(time).alias("last"))


def classify_overrides(records: DataFrame, max_jaccard: float | None = None) -> DataFrame:
    """records with `status` (accepted, rejected_failed, rejected_missing_input, rejected_jaccard, skipped), `override_input` and `override_source`."""
    raw = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("neutral", "synthetic_input", "input")), F.lit(""))
    out = records.withColumn("style_type", T.strip(F.coalesce("style_type", F.lit("")))).withColumn("override_input", T.clean(raw))
    good = F.col("synthetic_ok").eqNullSafe(F.lit(True)) | F.col("failed").eqNullSafe(F.lit(False))
    status = F.when((F.col("style_type") == "") | F.col("post_id").isNull(), "skipped").when(~good, "rejected_failed").when(F.col("override_input") == "", "rejected_missing_input")
    if max_jaccard is not None:
        status = status.when(F.coalesce(F.col("jaccard") >= max_jaccard, F.lit(True)), "rejected_jaccard")
    mode = T.strip(F.coalesce("prompt_mode", F.lit("")))
    source = F.when(mode != "", F.concat(F.lit("llm_"), mode)).otherwise("llm_synthetic")
    return out.withColumn("status", status.otherwise("accepted")).withColumn("override_source", source)


def override_stats(classified: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return classified.agg(F.count("*").alias("loaded"), *(count(s) for s in ("accepted", "rejected_failed", "rejected_missing_input", "rejected_jaccard")))


def accepted_overrides(classified: DataFrame, position: str) -> DataFrame:
    """(style_type, post_id, override_input, override_source): of several for a key the last by `position`."""
    last = F.max_by(F.struct("override_input", "override_source"), F.col(position)).alias("o")
    return classified.where("status = 'accepted'").groupBy("style_type", "post_id").agg(last).select("style_type", "post_id", "o.*")


def build_records(posts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Processed records of split posts with features: cleaned text, heuristic brief or override, prompt."""
    body = T.clean(F.col("text"))
    out = posts.withColumn("response_clean", body).withColumn("input_heuristic", T.heuristic_brief(F.col("response_clean")))
    if overrides is None:
        out = out.withColumn("input", F.col("input_heuristic")).withColumn("input_source", F.lit("heuristic"))
    else:
        out = out.join(overrides, ["style_type", "post_id"], "left")
        out = out.withColumns({"input": F.coalesce("override_input", "input_heuristic"), "input_source": F.coalesce("override_source", F.lit("heuristic"))})
    style, text, answer = F.col("style_type"), F.col("input"), F.col("response_clean")
    return out.select(
        "post_id", F.col("date").cast("string").alias("date"), "split", "style_type", "channel", prompts.instruction(style).alias("instruction"), "input", "input_source",
        "input_heuristic", F.col("text").alias("response_raw"), "response_clean", "group_id", "source_text_hash", F.lit("temporal").alias("split_strategy"),
        F.col("char_len").cast("int").alias("char_len"), F.col("n_paragraphs").cast("int").alias("n_paragraphs"), "has_emoji", "ends_with_question", prompts.training_prompt(style, text, answer).alias("prompt"),
    )


def max_token_filter(df: DataFrame, max_tokens: int, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(rows within the limit, one row of dropped, max_tokens and the discrete p95 of all)."""
    counted = df.withColumn("n_tokens", tokens)
    over = F.when(F.col("n_tokens") > max_tokens, 1)
    s = summaries(counted, {"n": ("n_tokens", [0.95]), "over": (over, [1.0])}, disc=True)
    kind = counted.schema["n_tokens"].dataType
    stats = s.select(F.col("over.n").alias("dropped"), F.col("n.max").cast(kind).alias("max_tokens"), F.col("n.q")[0].cast("long").alias("p95"))
    return counted.where(F.col("n_tokens") <= max_tokens), stats


def prefix_limit(df: DataFrame, n: int, position: str) -> DataFrame:
    if n <= 0:
        raise ValueError("the limit must be positive")
    return df.where(F.col(position) < n)


def filter_by_source(df: DataFrame, source: str | None) -> DataFrame:
    """Records of one input source; all if none is named."""
    return df.where(F.col("input_source") == source) if source else df


def validation_rows(df: DataFrame, source: str | None, fallback: str = "error") -> DataFrame:
    """filter_by_source, or every row where that leaves none and fallback is `all`; `error` fails instead."""
    if fallback not in ("all", "error"):
        raise ValueError(f"unknown fallback {fallback!r}")
    own = filter_by_source(df, source)
    if not own.isEmpty():
        return own
    if fallback == "error":
        raise ValueError(f"no validation records of input source {source!r}")
    return df


def usable(df: DataFrame) -> DataFrame:
    """Synthetic records that are ok."""
    return df.where(F.col("synthetic_ok"))


def has_several(df: DataFrame, column: str) -> bool:
    """Whether a column has more than one value besides null; stops at the second."""
    return len(df.where(F.col(column).isNotNull()).select(column).distinct().take(2)) > 1


def response_text(df: DataFrame) -> Column:
    return F.coalesce(*[F.col(c) for c in ("response_clean", "response") if c in df.columns], F.lit(""))


def enrich(
    df: DataFrame, synthetic: str, method: str, model: str, created_at: Column, reason: Column | None = None, config: dict | None = None, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Synthetic records: metrics, blank input where failed, source name where not, a second check of numbers.

    config: the model's settings, kept as the struct synthetic_config (null without any);
    extra: further columns, which replace those of their name.
    """
    text, given = F.coalesce(F.col(synthetic), F.lit("")), reason if reason is not None else F.lit(None).cast("string")
    first = given.isNotNull() | (text == "")
    numbers = ~overlap.numbers_preserved(F.col("response_clean"), text)
    failed = first | numbers
    why = F.coalesce(given, F.when(text == "", "empty_after_clean").when(numbers, "numbers_not_preserved"))
    heuristic = F.col("input_heuristic") if "input_heuristic" in df.columns else F.coalesce(F.col("input"), F.lit(""))
    out = df.withColumns({"input_heuristic": heuristic, "__text": text, "synthetic_failed": failed, "failure_reason": why})
    out = out.withColumns(
        {
            "synthetic_input": F.when(F.col("synthetic_failed"), "").otherwise(F.col("__text")), "input": F.when(F.col("synthetic_failed"), "").otherwise(F.col("__text")),
            "input_source": F.when(F.col("synthetic_failed"), F.col("input_source")).otherwise(f"{method}_synthetic"), "synthetic_ok": ~F.col("synthetic_failed"),
            "usable_for_training": ~F.col("synthetic_failed"), "synthetic_method": F.lit(method), "synthetic_model": F.lit(model), "synthetic_created_at": created_at,
            "synthetic_config": F.struct(*(F.lit(v).alias(k) for k, v in config.items())) if config else F.lit(None).cast("string"),
            "synthetic_seed": F.lit(None).cast("int"), "__score": overlap.score(F.col("response_clean"), F.col("__text"), F.col("synthetic_failed")),
        }
    )
    return out.select("*", "__score.*").drop("__score", "__text").withColumns(extra or {})
