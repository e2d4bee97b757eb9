"""Licence scans by diagonal voting, in DataFrame operations only.

Every run of k words of a document is hashed and joined with the places of the same run in
the templates (k is WIDTH, or 2 and 1 for templates of fewer words). A hit votes for the
diagonal "place in the document less place in the template"; a copy of a template puts all
its votes on one diagonal, and each word put in or left out moves the rest to a neighbouring
one. Votes are counted by diagonal, diagonals up to MERGE apart are taken together (templates
of LONG words and more; shorter ones keep to one), and a span is verified by its words: the
template's words that lie under hits, over the longer of template and span, must reach `least`.
Hits carry their words and are joined by them too, so that no hash decides alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .decontaminate import MAX_LITERALS, words
from .license_templates import NOTICES, PHRASES, STATEMENTS
from .runtime import materialize

#: Words of a run that votes.
WIDTH = 4
#: Diagonals so far apart are one span, in templates of at least LONG words. Stray hits there stretch
#: a span by 2 * MERGE words at most, so that a whole copy of LONG words still reaches 0.8.
MERGE, LONG = 8, 64
_KEY = ["doc_id", "th", "th2"]


def templates_of(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, others: list[tuple[str, str]] = STATEMENTS + NOTICES) -> DataFrame:
    """template, label, base, text: phrases (base: each place of one counts) and other templates."""
    rows = [(label, True, text) for label, text in phrases] + [(label, False, text) for label, text in others]
    made = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text")) for i, (label, base, text) in enumerate(rows)]
    return spark.range(1).select(F.inline(F.array(*made)))


def _rest(a: Column, skip: int) -> Column:
    """The array without its first `skip` members."""
    return F.slice(a, skip + 1, F.greatest(F.size(a), F.lit(1)))


def _runs(w: Column, pairs: Column) -> dict[int, Column]:
    """By k: at each place of w the hash of the k words from there on, null where fewer follow."""

    def both(a: Column, b: Column) -> Column:
        return F.when(b.isNotNull(), F.xxhash64(a, b))

    return {1: F.transform(w, lambda a: F.xxhash64(a)), 2: pairs, WIDTH: F.zip_with(pairs, _rest(pairs, WIDTH - 2), both)}


def _pairs(w: Column) -> Column:
    return F.zip_with(w, _rest(w, 1), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def _hits(w: Column, hashes: Column, k: int, listed: list[int] | None) -> Column:
    """struct(k, pos, hash, run) of the runs whose hash is listed; of all, where there is no list."""

    def hit(h: Column, i: Column) -> Column:
        run = F.array_join(F.slice(w, i + 1, k), " ")
        return F.when(h.isNotNull() if listed is None else h.isin(listed), F.struct(F.lit(k).alias("k"), i.alias("pos"), h.alias("hash"), run.alias("run")))

    return F.array_compact(F.transform(hashes, hit))


def _grams(templates: DataFrame) -> DataFrame:
    """template, label, base, n (words), k, tpos, hash, run: the templates' runs."""
    t = templates.select("template", "label", "base", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("pairs", _pairs(F.col("w")))
    n, w = F.size("w"), F.col("w")
    parts = []
    for k, hashes in _runs(w, F.col("pairs")).items():
        own = n >= k if k == WIDTH else (n >= k) & (n < (2 if k == 1 else WIDTH))
        parts.append(t.where(own).select("template", "label", "base", n.alias("n"), F.inline(_hits(w, hashes, k, None))).withColumnRenamed("pos", "tpos"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _scan(documents: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, th2, n_words), and by document and diagonal what was found.

    th and th2 are hashes of the text; rows of equal id and text are one in the second table.
    """
    grams = materialize(_grams(templates), "license-grams", True)
    distinct = grams.select("k", "hash").distinct().limit(MAX_LITERALS + 1).collect()
    by_k = {k: [r["hash"] for r in distinct if r["k"] == k] for k in sorted(r["k"] for r in grams.select("k").distinct().collect())}  # three at most
    docs = documents.select("doc_id", F.xxhash64("text").alias("th"), F.hash("text").alias("th2"), words(F.col("text")).alias("w")).withColumn("pairs", _pairs(F.col("w")))
    runs, n_words = _runs(F.col("w"), F.col("pairs")), F.size("w").cast("long").alias("n_words")

    def hits(all_runs: bool) -> Column:
        return F.concat(*(_hits(F.col("w"), runs[k], k, None if all_runs else listed) for k, listed in by_k.items()))

    if not distinct:
        keys = (F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in _KEY)
        return docs.select(*_KEY, n_words), _diagonals(grams.select(*keys, "*", F.col("tpos").alias("pos")))
    if len(distinct) <= MAX_LITERALS:
        split = materialize(docs.select(*_KEY, n_words, hits(False).alias("hits")), "license-hits")
        spread = split.where(F.size("hits") > 0).select(*_KEY, F.inline("hits"))
        split = split.drop("hits")
    else:  # too many runs for a literal set: all runs of the documents are joined
        split = docs.select(*_KEY, n_words)
        spread = docs.select(*_KEY, F.inline(hits(True)))
    return split, _diagonals(spread.join(grams, ["k", "hash", "run"]))


def _diagonals(votes: DataFrame) -> DataFrame:
    """doc_id, th, th2, template, label, base, n, diagonal, score, start, end: each diagonal with its neighbours."""
    by = votes.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(*_KEY, "template", "label", "base", "n", "k", "diagonal").agg(F.array_sort(F.collect_set("tpos")).alias("places"))
    # a range of 2 * MERGE diagonals; the others' diagonals are spread out so that a range holds one
    spread = F.when((F.col("n") >= LONG) & ~F.col("base"), 1).otherwise(MERGE + 1)
    near = Window.partitionBy(*_KEY, "template").orderBy(F.col("diagonal") * spread).rangeBetween(-MERGE, MERGE)
    found = by.select(
        *_KEY, "template", "label", "base", "n", "k", "diagonal",
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places").over(near)))).alias("places"),
        F.min(F.col("diagonal") + F.element_at("places", 1)).over(near).alias("start"),
        F.max(F.col("diagonal") + F.element_at("places", -1) + F.col("k")).over(near).alias("end"),
    )
    step = F.zip_with("places", _rest(F.col("places"), 1), lambda a, b: F.least(F.col("k"), F.coalesce(b - a, F.col("k"))))
    covered = F.aggregate(step, F.lit(0), lambda total, x: total + x)
    score = covered / F.greatest(F.col("n"), F.col("end") - F.col("start"))
    return found.select(*_KEY, "template", "label", "base", "n", "diagonal", score.alias("score"), "start", "end")


def license_spans(documents: DataFrame, templates: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, label, start, end (words, end exclusive), score: verified spans, the best of overlapping ones of a label.

    Rows of equal id and text give their spans once. See scan_licenses for nulls and empty tables.
    """
    found = _scan(documents, templates)[1].where(F.col("score") >= least)
    order = Window.partitionBy(*_KEY, "label").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", (before.isNull() | (F.col("start") >= before)).cast("int")).withColumn("island", F.sum("new").over(order))
    best = marked.groupBy(*_KEY, "label", "island").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("r"))
    return best.select("doc_id", "label", (-F.col("r.s")).alias("start"), F.col("r.end").alias("end"), F.col("r.score").alias("score"))


def scan_licenses(documents: DataFrame, templates: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of documents.

    n_base counts all places where a base template stands word for word, first_word and
    last_word are the smallest and largest of them. labels are those of verified spans, base
    ones included; score is the best share that any span reaches, verified or not (0 without
    hits). Null and empty texts have no words; templates without words find nothing; either
    table may be empty; equal rows get equal results; further columns are ignored.
    """
    split, found = _scan(documents, templates)
    whole = F.col("base") & (F.col("score") == 1)
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    own = found.groupBy(*_KEY).agg(
        F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("start"))).alias("first_word"), F.max(F.when(whole, F.col("start"))).alias("last_word"),
        names(whole).alias("base_labels"), names(F.col("score") >= least).alias("labels"), F.max("score").alias("score"),
    ).select(F.col("doc_id").alias("f_id"), F.col("th").alias("f"), F.col("th2").alias("f2"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = split.join(own, F.expr("doc_id <=> f_id and th = f and th2 = f2"), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
