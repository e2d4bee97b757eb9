"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations only.

An item's windows are its runs of `width` consecutive words (an item with fewer words is
one window). A document holds a window only if it holds the window's rarest shingle (two
neighbouring words), so that shingle is the prefix that has to be joined: the shingles of
the items are ordered by how often the documents hold them, documents without any prefix
shingle drop out, and in the others a window can only start where its rarest shingle stands
at its own offset and the window still fits (positional and length bounds). Whole windows
are compared word by word at last. Shingles are compared by hash, which only adds work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower, materialize

#: Fixed value: what is not a word character, after A-Z became a-z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many shingles (8 bytes each) go into a scan as a literal hash set; of more, the shingles
#: of documents are joined with them. Either way gives the same rows.
MAX_LITERALS = 20_000


def words(text: Column) -> Column:
    """Words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def pairs(w: str) -> Column:
    """A hash for each word and its follower; the last word's stands for itself and nothing."""
    return F.zip_with(w, F.slice(F.col(w), F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b))


def single(w: str) -> Column:
    return F.transform(w, lambda a: F.xxhash64(F.lit(1), a))


def shingles(w: str, singles: bool) -> Column:
    return F.concat(pairs(w), single(w)) if singles else pairs(w)


def literals(shingle: DataFrame) -> str | None:
    """The values of a one-column table for an IN list; None if they are more than MAX_LITERALS."""
    rows = shingle.limit(MAX_LITERALS + 1).collect()
    return ", ".join(f"{r[0]}L" if r[0] > -(1 << 63) else "-9223372036854775807L - 1" for r in rows) if len(rows) <= MAX_LITERALS else None


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """item (string id), window (words joined by blanks), size: each item's distinct windows."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    return b.select(
        "item", size.alias("size"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("window"),
    ).distinct()


def _matches(documents: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, th, th2, n_words, candidates' text), items' windows, and where documents hold a window.

    th and th2 are hashes of the text; rows of equal id and text are one in the last table.
    """
    docs = documents.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.hash("text").alias("th2"), "text", words(F.col("text")).alias("w"))
    windows = materialize(windows_of(benchmark, width), "windows")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most `width` numbers
    singles = 1 in sizes
    docs = docs.withColumn("s", shingles("w", singles))
    spelt = windows.select("window", "size").distinct().select("window", "size", F.posexplode(F.when(F.col("size") > 1, F.slice(pairs("window"), 1, F.col("size") - 1)).otherwise(single("window"))).alias("offset", "shingle"))
    vocabulary = materialize(spelt.select("shingle").distinct(), "vocabulary")
    listed = literals(vocabulary)
    if listed == "":
        held = docs.where("false").select(F.explode("s").alias("shingle"))
    elif listed:
        held = docs.select(F.explode(F.expr(f"filter(s, x -> x in ({listed}))")).alias("shingle"))
    else:
        held = docs.select(F.explode("s").alias("shingle")).join(vocabulary, "shingle", "left_semi")
    frequency = materialize(held.groupBy("shingle").agg(F.count("*").alias("df")), "frequency")
    # the rarest shingle of each window and its offset; a window with one that no document holds drops out
    prefix = materialize(
        spelt.join(frequency, "shingle", "left").groupBy("window", "size")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("r"))
        .where("r.df > 0").select("window", "size", F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset")),
        "prefix",
    )
    rare = prefix.select("shingle").distinct()
    key = ["doc_id", "th", "th2"]
    n_words = F.size("w").cast("long").alias("n_words")
    listed = literals(rare)
    if listed == "":
        may_hit = F.lit(False)
    elif listed:
        may_hit = F.expr(f"exists(s, x -> x in ({listed}))")
    else:
        holders = docs.select(*key, F.explode("s").alias("shingle")).join(rare, "shingle", "left_semi")
        holders = holders.select(F.col("doc_id").alias("h_id"), F.col("th").alias("h"), F.col("th2").alias("h2")).distinct().withColumn("held", F.lit(True))
        docs = docs.join(holders, F.expr("doc_id <=> h_id and th = h and th2 = h2"), "left")
        may_hit = F.coalesce("held", F.lit(False))
    split = materialize(docs.select(*key, n_words, F.when(may_hit, F.col("text")).alias("text")), "candidates")
    texts = split.where("text is not null").dropDuplicates(key).withColumn("w", words(F.col("text"))).drop("text")
    # the words themselves must not be carried into a row for each shingle
    spread = texts.select(*key, F.size("w").alias("n"), shingles("w", singles).alias("s"))
    at = spread.select(*key, "n", F.posexplode("s").alias("pos", "shingle"))
    # single words follow the pairs in the list, so that their places count anew from n
    at = at.withColumn("pos", F.expr("if(pos >= n, pos - n, pos)"))
    starts = at.join(prefix, "shingle").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0 and start + size <= n")
    starts = starts.select(*key, "start", "size", "window").distinct()
    same = F.expr("d.doc_id <=> s.doc_id and d.th = s.th and d.th2 = s.th2")
    met = (
        starts.alias("s").join(texts.alias("d"), same)
        .where(F.slice("d.w", F.col("s.start") + 1, F.col("s.size")) == F.col("s.window"))
        .select("s.*")
    )
    met = materialize(met, "met")
    return split, windows, met


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of documents.

    Null or empty texts have no words and hit nothing; items without words have no window.
    Items are named by their item_id as a string (equal ids are one item; a null id is no
    item, though its windows hit). Repeated document rows get the same result each. Further
    columns on either side are ignored; either table may be empty.
    """
    split, windows, met = _matches(documents, benchmark, width)
    key = ["doc_id", "th", "th2"]
    hit = met.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p")).groupBy(*key).agg(F.count_distinct("p").alias("n_hit"))
    items = (
        met.select(*key, "window").distinct().join(windows.select("item", "window").where("item is not null"), "window")
        .groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = hit.join(items, F.expr("true") & hit["doc_id"].eqNullSafe(items["doc_id"]) & (hit["th"] == items["th"]) & (hit["th2"] == items["th2"]), "left").select(
        hit["doc_id"].alias("f_id"), hit["th"].alias("f"), hit["th2"].alias("f2"), "n_hit", "items"
    )
    out = split.drop("text").join(found, F.expr("doc_id <=> f_id and th = f and th2 = f2"), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def contaminated_keys(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(th, th2) = (xxhash64, hash) of the texts that hold a window."""
    return _matches(documents, benchmark, width)[2].select("th", "th2").distinct()
