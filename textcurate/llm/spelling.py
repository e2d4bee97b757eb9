"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams.

The vocabulary's bigrams are ordered by the number of words that hold them. One edit touches
two bigrams of a word at most, so two words that are one edit apart share one of the three
rarest bigrams of either, from which one rest of the word is the same in both: the edit lies
wholly before or wholly behind it. That is the position limit of the join: a word is sent
under each of its three rarest bigrams with everything before it (place from the start) and
with everything behind it (place from the end). The other rest holds the edit; one of its
halves is the same in both words and joins the key, so that groups stay small. What meets is
verified by edit distance.

Tables that grow with the vocabulary are joined by merging: words in files are small beside the
keys made of them, so Spark's estimates would have the driver hold and send millions of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower, materialize

#: Fixed value: what words are made of, after A-Z became a-z: 90 characters, so 8,100 bigrams at most.
RUNS = "[a-zÀ-ÿ]+"
#: Words share a bigram of the three rarest only if they have more than two bigrams.
LEAST_LENGTH = 4
RAREST = 3


def count_words(documents: DataFrame, least_length: int = 6, least: int = 5, drop_one_in: int | None = 199) -> DataFrame:
    """word, n: words of least_length characters or more that occur `least` times or more over all documents.

    drop_one_in: of a run whose crc32 (of "doc_id:run") it divides, the character at crc32 %
    length goes before counting, which plants misspellings; None: words stay as they are.
    """
    run, h = F.col("run"), F.col("h")
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower("text"), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)  # a run never grows
    word = run
    if drop_one_in:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % drop_one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length("run")))).otherwise(run)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rarest_bigrams(vocabulary: DataFrame) -> DataFrame:
    """word, at (place from 0): the three rarest bigrams of each word; ties by bigram, then place."""
    grams = vocabulary.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("at", "gram"))
    words = F.broadcast(grams.groupBy("gram").agg(F.count_distinct("word").alias("words")))  # 8,100 rows at most
    ranked = grams.join(words, "gram").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("words", "gram", "at"))), 1, RAREST).alias("r"))
    return ranked.select("word", F.explode("r.at").alias("at"))


def _keys(length: Column, fixed: Column, rest: Column, short: Column, side: int) -> list[Column]:
    """Join keys of the first and of the second half of the rest, as a pair of words of which the shorter has `length`.

    short: characters of the rest in the shorter word; its first half decides where both words are cut.
    """
    half = F.floor(short / 2).cast("int")
    last = F.substring(rest, F.length(rest) - (short - half) + 1, short - half)
    return [F.xxhash64(F.lit(2 * side + part), length, fixed, text) for part, text in enumerate((F.substring(rest, F.lit(1), half), last))]


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, near: pairs of words exactly one inserted, deleted or replaced character apart, in both directions."""
    least = vocabulary.agg(F.min(F.length("word"))).first()[0]
    if least is not None and least < LEAST_LENGTH:
        raise ValueError(f"words of fewer than {LEAST_LENGTH} characters can be one edit apart without a rare bigram in common")
    word, at, n = F.col("word"), F.col("at"), F.length("word")
    rare = materialize(rarest_bigrams(vocabulary), "spelling-bigrams", True)
    before, behind = F.substring(word, F.lit(1), at), F.substring(word, at + 3, n)

    def keys(longer: int) -> Column:
        both = ((F.substring(word, F.lit(1), at + 2), behind), (F.substring(word, at + 1, n), before))
        # a word without a rest on a side has no longer partner's place there but through its own rest of one character
        found = [k if not longer else F.when(F.length(rest) > 0, k) for side, (fixed, rest) in enumerate(both) for k in _keys(n - longer, fixed, rest, F.length(rest) - longer, side)]
        return F.array_compact(F.array(*found))

    own = rare.select("word", F.explode(keys(0)).alias("key"))
    longer = rare.select("word", F.explode(keys(1)).alias("key"))
    others = own.select(F.col("word").alias("other"), "key", F.lit(False).alias("longer")).unionByName(longer.select(F.col("word").alias("other"), "key", F.lit(True).alias("longer")))
    met = own.hint("merge").join(others, "key").where((F.col("longer") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    pairs = met.select("word", "other").distinct()
    return pairs.select(F.inline(F.array(F.struct(F.col("word"), F.col("other").alias("near")), F.struct(F.col("other").alias("word"), F.col("word").alias("near")))))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a table (word, form): where following forms ends. Forms lead to ever larger counts, so there is no ring."""
    known = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots", True)
    while True:
        further = known.select(F.col("word").alias("step"), F.col("root").alias("next"))
        joined = known.hint("merge").join(further, F.col("root") == F.col("step"), "left")
        if joined.where("next is not null").isEmpty():
            return known
        known = materialize(joined.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots", True)


def group_variants(documents: DataFrame, least_length: int = 6, least: int = 5, ratio: int = 5, drop_one_in: int | None = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each counted word.

    form is the near word of largest n (ties: smallest in code-point order) if that n is `ratio`
    times the word's own or more; root is where following forms ends, the word itself without
    a form. Null and empty texts have no words, a null id counts as an empty one, repeated rows
    count each, no rows give none; further columns are ignored. Words that differ in more than
    one character, or not at all, are never near.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in a ring")
    counted = materialize(count_words(documents, least_length, least, drop_one_in), "spelling-words", True)
    near = near_pairs(counted).hint("merge").join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    held = materialize(
        counted.hint("merge").join(best, "word", "left").withColumn("has", -F.col("b.m") >= ratio * F.col("n")).select(
            "word", F.when(F.col("has"), F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), -F.col("b.m")).alias("form_n")
        ),
        "spelling-forms", True,
    )
    ends = roots(held.where("form is not null"))
    return held.hint("merge").join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
