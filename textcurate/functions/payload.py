"""JSON answers of a text backend, parsed without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prompts import ANSWER_FIELDS, check_mode
from .text import strip


def strip_fences(c: Column) -> Column:
    """Without a code fence around the text."""
    c = F.regexp_replace(strip(c), r"(?iU)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(c, r"(?U)\s*```$", ""))


def _bullets(title: str, items: Column) -> Column:
    kept = F.filter(F.transform(items, strip), lambda x: x != "")
    lines = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(kept) > 0, F.concat(F.lit(title + ":\n"), lines))


def brief(topic: Column, facts: Column, entities: Column | None = None, numbers: Column | None = None) -> Column:
    """Topic, entities, numbers and facts, one section each; blank parts are left out."""
    t = strip(F.coalesce(topic, F.lit("")))
    parts = [F.when(t != "", F.concat(F.lit("Topic: "), t))]
    for title, items in (("Entities", entities), ("Numbers", numbers), ("Facts", facts)):
        if items is not None:
            parts.append(_bullets(title, items))
    return F.concat_ws("\n", *parts)


def parse(df: DataFrame, content: str, mode: str = "rewrite", plaintext: bool = False, to: str = "parsed", error: str = "parse_error") -> DataFrame:
    """df with the text of an answer and, where it is unusable, the reason instead.

    Invalid JSON is an error, or the text itself with `plaintext`; a list field that is no
    list is an error; missing fields are empty. An empty answer is an empty text.
    """
    fields = ANSWER_FIELDS[check_mode(mode)]
    body = strip_fences(F.coalesce(F.col(content), F.lit("")))
    v = F.try_parse_json(F.col("__body"))
    text = lambda k: F.coalesce(F.try_variant_get(F.col("__v"), f"$.{k}", "string"), F.lit(""))
    items = lambda k: F.coalesce(F.try_variant_get(F.col("__v"), f"$.{k}", "array<string>"), F.array().cast("array<string>"))
    bad = F.when(F.col("__body") == "", None).when(F.col("__v").isNull(), None if plaintext else "invalid_json")
    for k, kind in fields.items():
        if kind == "array":
            own = F.try_variant_get(F.col("__v"), f"$.{k}", "variant")
            bad = bad.when(own.isNotNull() & ~F.startswith(F.schema_of_variant(own), F.lit("ARRAY")), f"invalid_{k}")
    made = strip(text("neutral_text")) if mode == "rewrite" else brief(text("topic"), *(items(k) for k in ("facts", "entities", "numbers") if k in fields))
    made = F.when(F.col("__body") == "", "").when(F.col("__v").isNull(), F.col("__body") if plaintext else None).otherwise(made)
    out = df.withColumn("__body", body).withColumn("__v", v).withColumn(error, bad)
    return out.withColumn(to, F.when(F.col(error).isNull(), made)).drop("__body", "__v")
