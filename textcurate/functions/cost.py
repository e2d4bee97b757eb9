"""Token usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# USD per million tokens, input and output; defaults of the estimate.
PRICES = {
    "google/gemini-2.5-flash-lite": (0.10, 0.40),
    "openai/gpt-4.1-mini": (0.40, 1.60),
    "google/gemini-2.5-flash": (0.30, 2.50),
    "anthropic/claude-haiku-4.5": (1.00, 5.00),
    "openai/gpt-4.1": (2.00, 8.00),
}
OVERHEAD, CHARS_PER_TOKEN, COMPLETION_RATIO, MIN_COMPLETION = 150, 1.7, 0.9, 32


def estimate_usage(text: Column, overhead: int = OVERHEAD, chars_per_token: float = CHARS_PER_TOKEN, ratio: float = COMPLETION_RATIO, least: int = MIN_COMPLETION) -> Column:
    """Struct of prompt_tokens, completion_tokens and total_tokens by the text's stripped length."""
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be > 0")
    n = F.length(strip(F.coalesce(text, F.lit("")))).cast("double")
    prompt = F.lit(overhead) + F.ceil(n / chars_per_token)
    completion = F.greatest(F.lit(least).cast("long"), F.ceil(n * ratio / chars_per_token))
    return F.struct(prompt.cast("long").alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).cast("long").alias("total_tokens"))


def cost_usd(prompt: Column, completion: Column, model: Column | str, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """USD to 6 places; null for a model without a price. The price book is a literal of a few rows."""
    model = F.lit(model) if isinstance(model, str) else model
    out = F.lit(None).cast("double")
    for name, (p, c) in (prices or PRICES).items():
        out = F.when(model == name, F.round(prompt / F.lit(1_000_000) * p + completion / F.lit(1_000_000) * c, 6)).otherwise(out)
    return out


def usage_total(prompt: Column, completion: Column, total: Column) -> Column:
    """total, or the sum where it is missing or 0."""
    return F.coalesce(F.nullif(total, F.lit(0)), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))


def summarize(df: DataFrame, model: str | None = None, estimate_missing: bool = False, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """usage_* sums, numbers of recorded and estimated rows and cost_usd_estimate (null if no row has one).

    With rollup, of each group and of all rows (then __all is 1) in one pass.
    """
    p, c = F.coalesce("usage_prompt_tokens", F.lit(0)), F.coalesce("usage_completion_tokens", F.lit(0))
    recorded = (p > 0) | (c > 0)
    guess = estimate_usage(F.col("response_clean"))
    estimated = ~recorded & F.lit(bool(estimate_missing and model))
    rows = df.withColumn("__rec", recorded).withColumn("__est", estimated).withColumn("__guess", guess)
    rows = rows.withColumn("__p", F.when(F.col("__est"), F.col("__guess.prompt_tokens")).otherwise(p)).withColumn("__c", F.when(F.col("__est"), F.col("__guess.completion_tokens")).otherwise(c))
    priced = cost_usd(F.col("__p"), F.col("__c"), model) if model else F.lit(None).cast("double")
    cost = F.when(F.col("__est"), priced).when(F.col("__rec"), F.coalesce("cost_usd_estimate", priced)).otherwise(F.col("cost_usd_estimate"))
    rows = rows.withColumn("__cost", cost)
    return (rows.rollup(*by) if rollup else rows.groupBy(*(by or []))).agg(
        *([F.grouping(by[0]).alias("__all")] if rollup else []),
        F.coalesce(F.sum("__p"), F.lit(0)).alias("usage_prompt_tokens"), F.coalesce(F.sum("__c"), F.lit(0)).alias("usage_completion_tokens"),
        F.coalesce(F.sum(F.col("__p") + F.col("__c")), F.lit(0)).alias("usage_total_tokens"), F.count_if("__rec").alias("usage_actual_records"),
        F.count_if("__est").alias("usage_estimated_records"), F.round(F.sum("__cost"), 6).alias("cost_usd_estimate"),
    )
