"""How filters interact: what each keeps, removes and spares in every order, from one count of masks.

A document's mask has a bit for each filter that it fails. Documents are counted once by part
and mask; a subset-zeta transform turns the counts into survivors for every subset of filters
(those whose mask lies in the subset's complement), and a step of an order is the difference
between two neighbouring subsets. Label counts go the same way. Only the count reads documents.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: Fixed value: white space between words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Orders of more filters than these are too many rows for each part.
MOST_FILTERS = 7


def standard_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by filter name: too short, repetitive, many capitals, markup signs."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, BLANKS), "")
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(t).cast("long"),
        "D": t.rlike("[#$%&*|]"),
    }


def mask_counts(documents: DataFrame, labels: DataFrame, part: str, failures: dict[str, Column], copies: str | None = None) -> DataFrame:
    """part, mask, total, good, toxic: rows of each part by what they fail; bit k of mask is the k-th filter.

    copies: name of a further, last filter that a row fails if its text stands under a smaller
    doc_id too. Copies are found by counting, without sending texts: rows of equal id, text
    digest and marks are counted, the smallest id of a digest is the least over its groups, and
    the rows that hold it pass. Null ids are neither smaller nor larger than any.
    """
    flags = F.array(*failures.values())
    rows = documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), flags.alias("flags"))
    bits = sum((F.when(F.coalesce(F.get("flags", F.lit(k)), F.lit(False)), 1 << k).otherwise(0) for k in range(len(failures))), F.lit(0))
    rows = rows.select("doc_id", "part", F.col("digest") if copies else F.lit(b"").alias("digest"), bits.cast("int").alias("mask"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("l_id"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    own = rows.join(marks, F.col("doc_id") == F.col("l_id"), "left").select("doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    group = ["digest", "part", "mask", "good", "toxic"]
    same = own.groupBy("doc_id", *group).agg(F.count("*").alias("c"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    by_text = same.groupBy(*group).agg(F.sum("c").alias("c"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("c"))).alias("known"), least.alias("least"))
    if copies:
        by_text = materialize(by_text, "audit-texts", True)
        first = by_text.groupBy(F.col("digest").alias("d")).agg(F.min("least.doc_id").alias("first"))
        held = by_text.join(first, F.col("digest") == F.col("d")).withColumn("pass", F.when(F.col("least.doc_id") == F.col("first"), F.col("least.c")).otherwise(0))
        held = held.withColumn("pass", F.col("pass") + F.col("c") - F.coalesce("known", F.lit(0)))
        one = F.struct("mask", F.col("pass").alias("c"))
        two = F.struct((F.col("mask") + (1 << len(failures))).alias("mask"), (F.col("c") - F.col("pass")).alias("c"))
        counts = held.select("part", "good", "toxic", F.inline(F.array(one, two)))
    else:
        counts = by_text
    return counts.groupBy("part", "mask").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("good")).alias("good"), F.sum(F.col("c") * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame, filters: int, measures: tuple[str, ...] = ("total", "good", "toxic")) -> DataFrame:
    """part, and for each measure an array: at place S, how much of it fails no filter of the subset S.

    Counts by mask become, filter by filter, sums over all masks inside a mask (the zeta
    transform); the survivors of S are the sum inside its complement.
    """
    size = 1 << filters
    spread = counts.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(m))), F.lit(0)) for k in range(size))).alias(m) for m in measures))

    def with_filter(m: str, bit: int) -> Column:
        return F.transform(m, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(m, i.bitwiseXOR(bit))).otherwise(0)).alias(m)

    for k in range(filters):
        spread = spread.select("part", *(with_filter(m, 1 << k) for m in measures))
    return spread.select("part", *(F.reverse(m).alias(m) for m in measures))  # S and its complement add up to size - 1


def order_steps(alive: DataFrame, names: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the filters.

    shapley is what a step's filter removes, summed over all orders.
    """
    n = len(names)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    everything, steps = (1 << n) - 1, []
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(names[x] for x in order), step, k, before))
            before |= 1 << k

    def removed(k: int) -> Column:
        """Of the k-th filter over all orders: |S|! (n - 1 - |S|)! orders have exactly the filters of S before it."""
        sets = [s for s in range(1 << n) if not s >> k & 1]
        weight = {s: factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1")) for s in sets}
        return sum(((F.get("total", F.lit(s)) - F.get("total", F.lit(s | 1 << k))) * weight[s] for s in sets), F.lit(0))

    known = alive.withColumn("shares", F.array(*(removed(k) for k in range(n))))
    listed = F.from_json(F.lit(json.dumps([{"o": o, "s": s, "k": k, "b": b, "bit": 1 << k} for o, s, k, b in steps])), "array<struct<o:string,s:int,k:int,b:int,bit:int>>")
    rows, at = known.select("*", F.inline(listed)), F.get
    after = F.col("b") + F.col("bit")
    gone = at("total", F.col("b")) - at("total", after)
    fails = at("total", F.lit(0)) - at("total", F.col("bit"))
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), at("total", after).alias("kept"), gone.alias("removed"), (fails - gone).alias("redundant"),
        (at("total", F.lit(everything) - F.col("bit")) - at("total", F.lit(everything))).alias("unique_fails"),
        (at("good", F.col("b")) - at("good", after)).alias("good_lost"), (at("toxic", F.col("b")) - at("toxic", after)).alias("toxic_lost"), F.get("shares", F.col("k")).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, part: str = "lang", failures: dict[str, Column] | None = None, copies: str | None = "E") -> DataFrame:
    """One row for each value of `part`, order of the filters and step; see order_steps for its columns.

    failures: by filter name (one character each), a condition that is true for rows to remove
    (a null condition removes none); standard_failures unless given. copies names the filter for
    texts that a smaller doc_id has too; None leaves it out. Null parts count as '', null texts
    as empty. An id with several labels is good, or toxic, if one of them says so; unlabelled
    rows are neither. Equal rows of one id are no copies of one another. No rows give none;
    further columns are ignored.
    """
    chosen = standard_failures(F.col("text")) if failures is None else failures
    names = [*chosen, *([copies] if copies else [])]
    return order_steps(survivors(mask_counts(documents, labels, part, chosen, copies), len(names)), names)
