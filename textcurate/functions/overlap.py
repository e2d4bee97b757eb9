"""Overlap of two texts, quality flags and the validation cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Thresholds that define the results.
NUMBERS_KEPT = 0.8
LENGTH_COLLAPSE = 0.4
JACCARD_BINS = [(0.2, "<0.2"), (0.3, "0.2-0.3"), (0.5, "0.3-0.5"), (0.7, "0.5-0.7")]
JACCARD_TOP = "≥0.7"
MAX_JACCARD = 0.5
STRICT = {"max_shared_ngram": 5, "max_copy_ratio": 0.25}
BORDERLINE = (0.30, 0.45)


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""

    def ratio(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        union = F.size(x) + F.size(y)
        return F.when(union == 0, F.lit(1.0)).otherwise(T.bind(both, lambda n: n / F.greatest(union - n, F.lit(1))))

    return T.bind(a, lambda x: T.bind(b, lambda y: ratio(x, y)))


def jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(T.word_set(a), T.word_set(b))


def numbers_preserved(original: Column, new: Column, least: float = NUMBERS_KEPT) -> Column:
    n = T.numbers(original)
    kept = F.size(F.array_intersect(n, T.numbers(new))) / F.greatest(F.size(n), F.lit(1))
    return F.when(F.size(n) == 0, F.lit(True)).otherwise(kept >= least)


def jaccard_bin(value: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for top, label in JACCARD_BINS:
        out = out.when(value < top, label)
    return out.otherwise(JACCARD_TOP)


def _hashes(toks: Column) -> Column:
    return F.transform(toks, lambda w: F.xxhash64(w))


def _longer(grams: Column, words: Column, n: int) -> Column:
    """Hashes of the (n + 1)-grams from those of the n-grams and of the words."""
    return F.zip_with(F.slice(grams, F.lit(1), F.size(grams) - 1), F.slice(words, F.lit(n + 1), F.size(grams) - 1), lambda g, w: F.xxhash64(g, w))


def longest_common_ngram(a: Column, b: Column, max_n: int = 8) -> Column:
    """The most words, up to max_n, of a run that both texts hold."""
    return common_run(T.tokens(a), T.tokens(b), max_n)


def common_run(a: Column, b: Column, max_n: int = 8) -> Column:
    """longest_common_ngram of two arrays of words; n-grams are compared by 64-bit hashes.

    A run of n words holds runs of fewer, so longer ones are only made where the shorter are shared.
    """

    def longest(x: Column, y: Column) -> Column:
        def from_(n: int, p: Column, q: Column) -> Column:
            if n == max_n:
                more = F.lit(n)
            else:
                more = T.bind(_longer(p, x, n), lambda p2: T.bind(_longer(q, y, n), lambda q2: from_(n + 1, p2, q2)))
            return F.when(F.arrays_overlap(p, q), more).otherwise(F.lit(n - 1))

        return from_(1, x, y)

    return T.bind(_hashes(a), lambda x: T.bind(_hashes(b), lambda y: longest(x, y)))


def copied_ngram_ratio(source: Column, candidate: Column, n: int = 4) -> Column:
    """Share of the candidate's n-grams, each occurrence counted, that the source holds."""
    return copied_share(T.tokens(source), T.tokens(candidate), n)


def copied_share(source: Column, candidate: Column, n: int = 4) -> Column:
    """copied_ngram_ratio of two arrays of words.

    The n-grams of both sides are sorted together, the source's before equal ones of the
    candidate, and one walk counts the latter: no text length is worth a quadratic search.
    """

    def grams(words: Column) -> Column:
        def up_to(k: int) -> Column:
            return words if k == 1 else T.bind(up_to(k - 1), lambda g: _longer(g, words, k - 1))

        return F.when(F.size(words) >= n, up_to(n)).otherwise(F.array().cast("array<bigint>"))

    tag = lambda c, side: F.transform(c, lambda g: F.struct(g.alias("g"), F.lit(side).alias("side")))

    def ratio(src: Column, cand: Column) -> Column:
        both = F.array_sort(F.concat(tag(F.array_distinct(src), 0), tag(cand, 1)))
        start = F.struct(F.lit(0).cast("long").alias("g"), F.lit(False).alias("seen"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(
            F.when(x["side"] == 0, x["g"]).otherwise(acc["g"]).alias("g"), (acc["seen"] | (x["side"] == 0)).alias("seen"),
            (acc["n"] + F.when((x["side"] == 1) & acc["seen"] & (x["g"] == acc["g"]), 1).otherwise(0)).alias("n"),
        )
        copied = F.aggregate(both, start, step, lambda acc: acc["n"])
        return F.when((F.size(src) == 0) | (F.size(cand) == 0), F.lit(0.0)).otherwise(copied / F.greatest(F.size(cand), F.lit(1)))

    words = lambda a, f: T.bind(_hashes(a), f)
    return words(source, lambda x: words(candidate, lambda y: T.bind(grams(x), lambda s: T.bind(grams(y), lambda c: ratio(s, c)))))


def length_ratio(original: Column, new: Column) -> Column:
    return F.length(new) / F.greatest(F.length(original), F.lit(1))


def score(original: Column, new: Column, failed: Column) -> Column:
    """Struct of jaccard, is_identity, numbers_preserved, length_ratio and quality_flags.

    Of failed rows the two truth values are false and the measures null.
    """
    same, kept = T.strip(new) == T.strip(original), numbers_preserved(original, new)
    return _scored(failed, jaccard(original, new), same, kept, length_ratio(original, new))


def _scored(failed: Column, j: Column, same: Column, kept: Column, ratio: Column) -> Column:
    ok, true = lambda c: F.when(~failed, c), lambda c: F.when(failed, False).otherwise(c)
    flags = F.struct(
        true(kept).alias("numbers_ok"), true(same).alias("identity"), jaccard_bin(ok(j)).alias("jaccard_bin"), ok(ratio < LENGTH_COLLAPSE).alias("length_collapse")
    )
    return F.struct(
        ok(F.round(j, 4)).alias("jaccard"), true(same).alias("is_identity"), true(kept).alias("numbers_preserved"), ok(F.round(ratio, 4)).alias("length_ratio"), flags.alias("quality_flags")
    )


def with_validation(
    df, original: str, candidate: str, *, max_jaccard: float = MAX_JACCARD, max_shared_ngram: int | None = None,
    max_copy_ratio: float | None = None, copy_ngram: int = 4, strict_zero: bool = True, to: str = "validation", ngrams: bool = True,
):
    """df with a struct: neutralized_clean, failed, failure_reason, longest_common_ngram, copy_ngram_ratio and the metrics.

    The first rule that fails names the reason: empty_after_clean, numbers_not_preserved,
    identity, high_overlap, copied_span, copied_{n}gram_ratio. With strict_zero a Jaccard of 0
    counts as high_overlap, as in the checks this reproduces. Without `ngrams` the two n-gram
    columns are null unless a limit needs them. Columns that the steps need are computed once
    and dropped.
    """
    o, c, x, y = F.col(original), F.col("__clean"), F.col("__x"), F.col("__y")
    rounded = F.round("__j", 4)
    j = F.when(rounded == 0, F.lit(1.0)).otherwise(rounded) if strict_zero else rounded
    steps = df.withColumn("__clean", F.coalesce(T.clean(F.col(candidate)), F.lit(""))).withColumns({"__x": T.tokens(o), "__y": T.tokens(c)})
    run = common_run(x, y) if ngrams or max_shared_ngram is not None else F.lit(None).cast("int")
    copied = copied_share(x, y, copy_ngram) if ngrams or max_copy_ratio is not None else F.lit(None).cast("double")
    steps = steps.withColumns(
        {"__j": set_jaccard(F.array_distinct(x), F.array_distinct(y)), "__n": run, "__r": copied, "__same": T.strip(c) == T.strip(o), "__num": numbers_preserved(o, c)}
    )
    reason = F.when(c == "", "empty_after_clean").when(~F.col("__num"), "numbers_not_preserved").when(F.col("__same"), "identity").when(j >= max_jaccard, "high_overlap")
    if max_shared_ngram is not None:
        reason = reason.when(F.col("__n") >= max_shared_ngram, "copied_span")
    if max_copy_ratio is not None:
        reason = reason.when(F.col("__r") >= max_copy_ratio, f"copied_{copy_ngram}gram_ratio")
    steps = steps.withColumn("__why", reason)
    why, failed = F.col("__why"), F.col("__why").isNotNull()
    spoken = ~F.coalesce(why.isin("numbers_not_preserved", "identity"), F.lit(False))
    steps = steps.withColumn("__score", _scored(failed, F.col("__j"), F.col("__same"), F.col("__num"), length_ratio(o, c)))
    out = F.struct(
        F.when(failed, "").otherwise(c).alias("neutralized_clean"), failed.alias("failed"), why.alias("failure_reason"),
        F.when(spoken, F.col("__n")).alias("longest_common_ngram"), F.when(spoken, F.round(F.col("__r"), 4)).alias("copy_ngram_ratio"),
        *(F.col(f"__score.{k}").alias(k) for k in ("jaccard", "is_identity", "numbers_preserved", "length_ratio", "quality_flags")),
    )
    return steps.withColumn(to, out).drop("__clean", "__x", "__y", "__j", "__n", "__r", "__same", "__num", "__why", "__score")


def is_borderline(j: Column) -> Column:
    return F.coalesce((j >= BORDERLINE[0]) & (j < BORDERLINE[1]), F.lit(False))


def should_postedit(base: Column, strict: Column) -> Column:
    """base passed but is borderline, or strict failed for a copied run; both are validation structs."""
    copied = strict["failure_reason"].isin("copied_span", "copied_4gram_ratio")
    return (~base["failed"] & is_borderline(base["jaccard"])) | (strict["failed"] & F.coalesce(copied, F.lit(False)))


def validation_rank(v: Column, position: int) -> Column:
    """Sort key of validation structs: passed first, then least overlap; 0 and null count as 1 (shared run: as 0)."""
    return F.struct(
        v["failed"].alias("failed"), F.coalesce(F.nullif(v["jaccard"], F.lit(0.0)), F.lit(1.0)).alias("jaccard"),
        F.coalesce(F.nullif(v["copy_ngram_ratio"], F.lit(0.0)), F.lit(1.0)).alias("copy"), F.coalesce(v["longest_common_ngram"], F.lit(0)).alias("run"), F.lit(position).alias("position"),
    )


def better_validation(current: Column, new: Column) -> Column:
    return F.when(validation_rank(new, 1) < validation_rank(current, 0), new).otherwise(current)
