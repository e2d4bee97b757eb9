"""Exact quantiles of groups of any size.

Values are counted once (combined before the shuffle, so ties cost nothing). While a group has
more distinct values than one task should sort, approximate splitters cut it into cells, an
exact histogram of the cells says which hold the wanted ranks, and only those go on. What
is left is at most `bound` values a group, whose running counts give the ranks. The splitters
decide how fast groups shrink, never what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import checkpointed

#: Distinct values that one task sorts.
BOUND = 100_000
#: Splitters of a round.
SPLITTERS = 64


def _ranks(n: Column, probs: list[float], disc: bool) -> Column:
    """Ranks (from 0) that the quantiles of n values need."""
    if disc:
        return F.array(*(F.greatest(F.ceil(F.lit(p) * n) - 1, F.lit(0)).cast("long") for p in probs))
    at = [F.lit(p) * (n - 1) for p in probs]
    return F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil)))


def count_values(df: DataFrame, values: dict[str, str | Column], by: list[str] | None = None) -> DataFrame:
    """g (struct of `by`), which (number of the column, -1 for all rows), v, c: how often each group has each value. One pass over df."""
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    each = [F.struct(F.lit(i).alias("which"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")) for i, c in enumerate(values.values())]
    rows = df.select(group.alias("g"), F.inline(F.array(F.struct(F.lit(-1).alias("which"), F.lit(0.0).alias("v")), *each)))
    return checkpointed(rows.where("v is not null").groupBy("g", "which", "v").agg(F.count("*").alias("c")))


def quantiles(counted: DataFrame, probs: list[list[float]], disc: bool = False, bound: int = BOUND) -> DataFrame:
    """g and, for the k-th of the counted columns, q<k>: an array of its quantiles.

    A probability p stands for the value at p * (n - 1) of the n sorted values, in between by
    proportion; with `disc` for the first value that has p of the values at or before it. A
    group without values has null, without any column's values no row.
    """
    counted = counted.where("which >= 0")
    sizes = counted.groupBy("g", "which").agg(F.sum("c").alias("n"))
    ranks = F.lit(None).cast("array<long>")
    for i, p in enumerate(probs):
        ranks = F.when(F.col("which") == i, _ranks(F.col("n"), p, disc)).otherwise(ranks)
    key = ["g", "which", "path"]
    # path: the cells a group was narrowed to; base: values that come before them
    left = counted.withColumns({"path": F.lit(""), "base": F.lit(0).cast("long")})
    wanted = sizes.select("g", "which", "n", ranks.alias("ranks"))
    while (left.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > bound:
        left = checkpointed(_narrowed(left, wanted, key, bound))
    order = Window.partitionBy(*key).orderBy("v")
    told = left.withColumn("after", F.col("base") + F.sum("c").over(order)).withColumn("before", F.col("after") - F.col("c"))
    same = ["g", "which"]
    held = told.join(wanted, same).select(*same, "n", "v", F.explode(F.filter(F.array_distinct("ranks"), lambda r: (r >= F.col("before")) & (r < F.col("after")))).alias("rank"))
    found = held.groupBy(*same, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    return found.groupBy("g").agg(*(F.max(F.when(F.col("which") == i, _values(F.col("at"), F.col("n"), p, disc))).alias(f"q{i}") for i, p in enumerate(probs)))


def summaries(df: DataFrame, values: dict[str, tuple[str | Column, list[float]]], by: list[str] | None = None, disc: bool = False, bound: int = BOUND) -> DataFrame:
    """by, `rows` and for each name a struct n, mean, std_pop, std_samp, min, max, q (an array of quantiles), all from one pass over df.

    Null values don't count, null groups are a group. Without `by` there is one row, even of an empty table.
    """
    counted = count_values(df, {name: c for name, (c, _) in values.items()}, by)
    c, v = F.col("c"), F.col("v")
    parts = [F.sum(F.when(F.col("which") == -1, c)).alias("rows")]
    for i in range(len(values)):
        own = F.col("which") == i
        n, one, two = F.sum(F.when(own, c)), F.sum(F.when(own, v * c)), F.sum(F.when(own, v * v * c))
        apart = F.greatest(two - one * one / n, F.lit(0.0))
        parts.append(F.struct(
            F.coalesce(n, F.lit(0)).alias("n"), (one / n).alias("mean"), F.sqrt(apart / n).alias("std_pop"), F.when(n > 1, F.sqrt(apart / (n - 1))).alias("std_samp"),
            F.min(F.when(own, v)).alias("min"), F.max(F.when(own, v)).alias("max"),
        ).alias(f"s{i}"))
    found = quantiles(counted, [p for _, p in values.values()], disc, bound)
    if by:
        held = counted.groupBy("g").agg(*parts).join(found.withColumnRenamed("g", "q_g"), F.col("g").eqNullSafe(F.col("q_g")), "left")
    else:
        row = found.first()  # one row
        last = {f"q{i}": F.array(*(F.lit(x) for x in row[f"q{i}"])) if row and row[f"q{i}"] is not None else F.lit(None).cast("array<double>") for i in range(len(values))}
        held = counted.agg(*parts).withColumns(last)
    full = [F.col(f"s{i}").withField("q", F.col(f"q{i}")).alias(name) for i, name in enumerate(values)]
    return held.select(*(F.col(f"g.{x}").alias(x) for x in by or []), F.coalesce("rows", F.lit(0)).alias("rows"), *full)


def _narrowed(left: DataFrame, wanted: DataFrame, key: list[str], bound: int) -> DataFrame:
    """`left` with each group of more than `bound` values reduced to the cells that hold a wanted rank."""
    large = left.groupBy(*key).agg(F.count("*").alias("m"), F.percentile_approx("v", F.array(*(F.lit(i / SPLITTERS) for i in range(1, SPLITTERS))), F.lit(20 * SPLITTERS)).alias("splitters"))
    cell = F.when(F.col("m") > bound, F.size(F.filter("splitters", lambda s: s < F.col("v")))).otherwise(-1)
    celled = left.join(large, key).withColumn("cell", cell).drop("splitters", "m")
    cells = celled.groupBy(*key, "cell").agg(F.sum("c").alias("rows"), F.min("base").alias("base"))  # SPLITTERS for each group
    order = Window.partitionBy(*key).orderBy("cell")
    cells = cells.withColumn("base", F.col("base") + F.sum("rows").over(order) - F.col("rows"))
    kept = cells.join(wanted, ["g", "which"]).where(F.exists("ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("rows"))))
    kept = kept.select(*key, "cell", F.col("base").alias("start"))
    return celled.join(kept, [*key, "cell"]).select("g", "which", "v", "c", F.concat_ws(".", "path", "cell").alias("path"), F.col("start").alias("base"))


def _values(at: Column, n: Column, probs: list[float], disc: bool) -> Column:
    """The quantiles from the values at their ranks."""
    if disc:
        return F.transform(_ranks(n, probs, True), lambda r: F.element_at(at, r))
    out = []
    for p in probs:
        place = F.lit(p) * (n - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.element_at(at, low.cast("long")), F.element_at(at, high.cast("long"))
        out.append(F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b))
    return F.array(*out)
