"""Evaluation of generated text: lengths, quality, similarity, classes, distribution, memorisation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import fuzzy, overlap
from ..functions import text as T
from .posts import has_several
from .quantiles import summaries

# Quality gates.
QUALITY_TARGETS = {
    "jaccard_ge_0_5": ("<=", 0.05),
    "identity_rate": ("<=", 0.02),
    "number_preservation": (">=", 0.95),
    "length_collapse_rate": ("<=", 0.10),
    "good_neutral_rate": (">=", 0.70),
}
MEMORISATION = {"median_below": 60.0, "max_below": 100.0, "run_below": 30}


def length_stats(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Characters (stripped) mean, median, sample deviation, least and most; words mean and median; to 1 place."""
    half = [0.5]
    out = summaries(df, {"c": (F.length(T.strip(F.col(text))), half), "w": (T.blank_words(F.col(text)), half)}, by)
    one = lambda c, name: F.round(c, 1).alias(name)
    return out.select(
        *(by or []), F.col("rows").alias("n"), one("c.mean", "char_mean"), one(F.col("c.q")[0], "char_median"), one("c.std_samp", "char_std"),
        F.col("c.min").cast("int").alias("char_min"), F.col("c.max").cast("int").alias("char_max"), one("w.mean", "word_mean"), one(F.col("w.q")[0], "word_median"),
    )


def length_report(df: DataFrame, text: str = "text", by: str = "style_type") -> DataFrame:
    """length_stats of each group, or of all rows together where the column is missing or has one value."""
    several = by in df.columns and has_several(df, by)
    out = length_stats(df, text, [by] if several else None)
    return out if several else out.select(F.lit("all").alias(by), "*")


def length_compare(df: DataFrame, given: str, reference: str, generated: str | None = None) -> DataFrame:
    """df with characters and words of each text and their ratios to 3 places."""
    chars, words = lambda c: F.length(T.strip(F.col(c))), lambda c: T.blank_words(F.col(c))
    out = df.withColumns({"input_chars": chars(given), "input_words": words(given), "ref_chars": chars(reference), "ref_words": words(reference)})
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 3)
    out = out.withColumn("ref_input_char_ratio", ratio("ref_chars", "input_chars"))
    if generated:
        out = out.withColumns({"gen_chars": chars(generated), "gen_words": words(generated)})
        out = out.withColumns({"gen_input_char_ratio": ratio("gen_chars", "input_chars"), "gen_ref_char_ratio": ratio("gen_chars", "ref_chars")})
    return out


def zip_by_position(records: DataFrame, generated: DataFrame, position: str = "pos") -> DataFrame:
    """Records with the generated text of the same position; other counts on the two sides: with nulls instead."""
    same = records.count() == generated.count()
    if not same:
        return records.withColumn("generated", F.lit(None).cast("string"))
    return records.join(generated, position)


def summarize_quality(df: DataFrame, failed: str, by: list[str] | None = None) -> DataFrame:
    """n_total, n_active, failed_rate and, over rows that didn't fail, the rates to 4 places (null if there are none)."""
    live = ~F.col(failed)
    share = lambda c, among=None: F.round(F.avg(F.when(live if among is None else live & among, F.coalesce(c, F.lit(False)).cast("double"))), 4)
    digits = F.rlike(F.col("response_clean"), F.lit(r"\p{Nd}"))
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n_total"), F.count_if(live).alias("n_active"), F.round(F.avg(F.col(failed).cast("double")), 4).alias("failed_rate"),
        share(F.col("jaccard") >= 0.5).alias("jaccard_ge_0_5"), share(F.col("is_identity")).alias("identity_rate"), share(F.col("numbers_preserved"), digits).alias("number_preservation"),
        share(F.col("length_ratio") < 0.4).alias("length_collapse_rate"), share((F.col("jaccard") < 0.3) & ~F.col("is_identity")).alias("good_neutral_rate"),
        F.round(F.avg(F.when(live, F.col("length_ratio"))), 4).alias("mean_length_ratio"),
    )


def quality_gate(summary: DataFrame) -> DataFrame:
    """summary with {metric}_pass of each target and quality_gate_passed; a metric that is null fails the gate."""
    out, all_of = summary, F.lit(True)
    for m, (op, t) in QUALITY_TARGETS.items():
        ok = F.col(m) <= t if op == "<=" else F.col(m) >= t
        out = out.withColumn(f"{m}_pass", ok)
        all_of = all_of & F.coalesce(ok, F.lit(False))
    return out.withColumn("quality_gate_passed", all_of)


def report_by_type(df: DataFrame, by: str = "style_type") -> DataFrame:
    """Rows, failures and shares of low and high overlap; rows without a Jaccard value are left out of the shares."""
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    return df.groupBy(by).agg(
        F.count("post_id").alias("n"), share(F.col("failed")).alias("failed"),
        share(F.col("jaccard") >= 0.5).alias("share_ge_0_5"), share(F.col("jaccard") < 0.3).alias("share_lt_0_3"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, after L2 normalisation with the usual guard for null vectors."""
    x, y = F.transform(a, lambda e: e.cast("double")), F.transform(b, lambda e: e.cast("double"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    norm = lambda u: F.greatest(F.sqrt(dot(u, u)), F.lit(1e-12))
    return dot(x, y) / (norm(x) * norm(y))


def cosine_summary(df: DataFrame, column: str = "cosine", places: int = 6) -> DataFrame:
    r = lambda c, name: F.round(c, places).alias(name)
    c = summaries(df, {"c": (column, [0.5])})
    return c.select(r("c.mean", "mean"), r(F.col("c.q")[0], "median"), r("c.std_pop", "std"), r("c.min", "min"), r("c.max", "max"), F.col("c.n").alias("n"))


def confusion(df: DataFrame, actual: str, predicted: str, classes: list) -> DataFrame:
    """Row-normalised shares of each predicted class, a row for each actual class, with its rows."""
    n = F.count("*")
    return df.groupBy(actual).agg(n.alias("n"), *(F.round(F.count_if(F.col(predicted) == c) / n, 4).alias(f"to_{c}") for c in classes))


def class_scores(df: DataFrame, actual: str, predicted: str, probability: str) -> DataFrame:
    return df.agg(
        F.round(F.avg((F.col(actual) == F.col(predicted)).cast("double")), 4).alias("style_accuracy"), F.round(F.avg(probability), 4).alias("style_confidence"), F.count("*").alias("n")
    )


def hashed_trigrams(texts: list[str], dims: int = 256) -> np.ndarray:
    """Counts of each text's character trigrams in `dims` cells."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(c) > 2:
            h = (c[:-2] * np.uint64(961) + c[1:-1] * np.uint64(31) + c[2:]) * np.uint64(0x9E3779B97F4A7C15)
            out[i] = np.bincount((h >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
    return out


def embed(df: DataFrame, text: str, encode=None, to: str = "embedding", dims: int = 256) -> DataFrame:
    """df with a vector of each text; `encode` maps a list of texts to vectors, batch by batch, once loaded in a worker."""
    if encode is None:
        def encode(texts):
            return hashed_trigrams(texts, dims)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(texts.fillna("").tolist()), np.float32)))

    return df.withColumn(to, run(text))


def cosine_scores(df: DataFrame, a: str, b: str, encode=None) -> tuple[DataFrame, DataFrame]:
    """(df with the cosine of the embeddings of two texts a row, its summary)."""
    both = embed(embed(df, a, encode, "__a"), b, encode, "__b")
    out = both.withColumn("cosine", cosine(F.col("__a"), F.col("__b"))).drop("__a", "__b")
    return out, cosine_summary(out)


def word_grams(word: str, low: int = 2, high: int = 4) -> list[str]:
    """Character n-grams of a word padded by one blank on either side; where n reaches its length, the padded word ends them."""
    padded, out = f" {word} ", []
    for n in range(low, high + 1):
        if len(padded) <= n:
            out.append(padded)
            break
        out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def text_grams(text: str | None) -> Counter:
    """How often a text holds each n-gram of its lower-case words."""
    out: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        for g in word_grams(word):
            out[g] += n
    return out


#: Characters of texts whose n-grams are counted, or weighed, at once, or a text more.
COUNTED, WEIGHED = 2_000_000, 500_000
#: Characters that an n-gram of four can be made of to be one number of 64 bits; chunks of more go text by text.
DISTINCT = 65_535


def _chunks(texts, most: int) -> Iterator[list[str]]:
    """Runs of texts of `most` characters: lower-case words between single blanks, with a blank on either side; no words: empty."""
    held, n = [], 0
    for t in texts:
        words = (t or "").lower().split()
        held.append(f" {' '.join(words)} " if words else "")
        n += len(held[-1]) + 1
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts and the number of the text of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _windows(codes: np.ndarray, places: np.ndarray, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, number and start of each n-gram of words: the windows of 2 to 4 characters without a blank inside, or two of them.

    Texts begin and end with a blank, so no such window is in two texts.
    """
    blank, own, size = codes == 32, places.astype(np.uint64), np.uint64(base)
    keys = own
    for n in (2, 3, 4):
        if len(codes) < n:
            return
        keys = keys[:-1] * size + own[n - 1 :]
        whole = ~(blank[:-1] & blank[1:]) if n == 2 else ~blank[1:-1] if n == 3 else ~(blank[1:-2] | blank[2:-1])
        starts = np.flatnonzero(whole)
        yield n, keys[starts], starts


def count_grams(texts) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """n-grams, how often they occur and in how many texts, over runs of texts."""
    for chunk in _chunks(texts, COUNTED):
        codes, number = _codes(chunk)
        places = np.zeros(0x110000, np.int64)
        places[codes] = 1
        alphabet = np.flatnonzero(places)
        if len(alphabet) > DISTINCT:
            for own in map(text_grams, chunk):
                yield list(own), np.array(list(own.values()), np.int64), np.ones(len(own), np.int64)
            continue
        places[alphabet] = np.arange(len(alphabet))
        for n, keys, starts in _windows(codes, places[codes], len(alphabet)):
            which, found = pd.factorize(keys)
            both = np.sort(which * len(chunk) + number[starts])
            once = both[np.flatnonzero(np.diff(both, prepend=-1))] // len(chunk)
            digits = np.stack([found // np.uint64(len(alphabet) ** k) % np.uint64(len(alphabet)) for k in range(n - 1, -1, -1)], 1)
            spelt = alphabet[digits.astype(np.int64)].astype("<u4").tobytes().decode("utf-32-le")
            yield [spelt[i : i + n] for i in range(0, len(spelt), n)], np.bincount(which, minlength=len(found)), np.bincount(once, minlength=len(found))


def weigh_grams(texts, weights: dict[str, tuple[int, float]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors of runs of texts: how many texts, where each ends, indices and values of all."""
    idf = np.zeros(len(weights))
    for i, w in weights.values():
        idf[i] = w
    alphabet = sorted(set().union(*weights))
    places = np.zeros(0x110000, np.int64)  # 0: a character of no n-gram
    places[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    base, by_size = len(alphabet) + 1, {}
    if few := len(alphabet) < DISTINCT:
        for n in (2, 3, 4):
            grams = [g for g in weights if len(g) == n]
            keys = np.zeros(len(grams), np.uint64)
            for k in range(n):
                keys = keys * np.uint64(base) + places[[ord(g[k]) for g in grams]].astype(np.uint64)
            by_size[n] = pd.Index(keys), np.array([weights[g][0] for g in grams], np.int64)
    for chunk in _chunks(texts, WEIGHED):
        size = max(len(idf), 1)
        if few:
            codes, number = _codes(chunk)
            parts = [np.zeros(0, np.int64)]
            for n, keys, starts in _windows(codes, places[codes], base):
                held, index = by_size[n]
                at = held.get_indexer(keys)
                parts.append(number[starts[at >= 0]] * size + index[at[at >= 0]])
            both = np.sort(np.concatenate(parts))
            first = np.flatnonzero(np.diff(both, prepend=-1))
            both, times = both[first], np.diff(first, append=len(both))
        else:
            own = sorted((i * size + weights[g][0], n) for i, t in enumerate(chunk) for g, n in text_grams(t).items() if g in weights)
            both, times = np.array([x for x, _ in own], np.int64), np.array([n for _, n in own], np.int64)
        text, index = both // size, both % size
        values = idf[index] * (1 + np.log(times))
        norms = np.sqrt(np.bincount(text, values * values, len(chunk)))
        ends = np.cumsum(np.bincount(text, minlength=len(chunk)))
        yield len(chunk), ends.astype(np.int32), index.astype(np.int32), values / np.where(norms > 0, norms, 1.0)[text]


class StyleClassifier:
    """TF-IDF of character n-grams (sublinear counts, smoothed idf, L2) and a logistic regression.

    Texts become sparse vectors in one Arrow pass, runs of texts at a time. The driver holds `features` n-grams and
    their weights, the most frequent of the training texts.
    """

    def __init__(self, classes: list[str], features: int = 50_000):
        self.classes, self.features = classes, features

    def fit(self, df: DataFrame, text: str, label: str) -> StyleClassifier:
        from pyspark.ml.classification import LogisticRegression

        rows = df.select(F.col(text).alias("text"), (F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(label)).cast("double") - 1).alias("label"))

        n = rows.count()
        most = self.vocabulary(rows, "text").collect()
        self._weights = {r["gram"]: (i, float(np.log((1 + n) / (1 + r["texts"])) + 1)) for i, r in enumerate(sorted(most, key=lambda r: r["gram"]))}
        # on disk: the regression reads them twice and keeps blocks of its own in memory
        ready = self._vectors(rows, "text").select("label", "features").persist(StorageLevel.DISK_ONLY)
        self._model = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-4).fit(ready)
        ready.unpersist()
        return self

    def vocabulary(self, df: DataFrame, text: str) -> DataFrame:
        """gram, times, texts: the `features` most frequent n-grams of the texts."""

        def count(batches):
            for grams, times, texts in count_grams(t for b in batches for t in b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(times), pa.array(texts)], names=["gram", "times", "texts"])

        grams = df.select(text).mapInArrow(count, "gram string, times long, texts long").groupBy("gram").agg(F.sum("times").alias("times"), F.sum("texts").alias("texts"))
        return grams.orderBy(F.desc("times"), "gram").limit(self.features)

    def _vectors(self, df: DataFrame, text: str) -> DataFrame:
        """df with `features`, the weighted n-grams of its texts."""
        from pyspark.ml.linalg import VectorUDT

        shared, size = df.sparkSession.sparkContext.broadcast(self._weights), len(self._weights)  # `features` entries at most
        at, names = df.columns.index(text), [*df.columns, "features"]

        def run(batches):
            weights = shared.value
            for b in batches:
                start = 0
                for n, ends, indices, values in weigh_grams(b.column(at).to_pylist(), weights):
                    offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]))
                    parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(indices)), pa.ListArray.from_arrays(offsets, pa.array(values))]
                    vectors = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
                    yield pa.RecordBatch.from_arrays([*b.slice(start, n).columns, vectors], names=names)
                    start += n

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("features", VectorUDT())]))

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        """df with `predicted` and `probabilities` (in the order of classes)."""
        from pyspark.ml.functions import vector_to_array

        out = self._model.transform(self._vectors(df, text))
        names = F.array(*[F.lit(c) for c in self.classes])
        keep = [F.col(c) for c in df.columns]
        return out.select(*keep, F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), vector_to_array("probability").alias("probabilities"))


#: Restarts of the quantisation; the one of least cost counts.
STARTS = 5
#: Up to so many clusters are sought at once; more by splitting clusters in two, level by level.
FLAT = 256


def quantise(rows: DataFrame, features: str, clusters: int, to: str = "bin", seed: int = 42) -> DataFrame:
    """rows with the number of their cluster.

    k-means with STARTS seeds, the one of least summed distance. Its work grows with rows
    times clusters, so that for more than FLAT clusters, whose number follows the rows,
    clusters are halved level by level instead: each row is held against two centres a level.
    """
    from pyspark.ml.clustering import BisectingKMeans, KMeans

    if clusters > FLAT:
        # the costs of seeds differ little there, as every level starts from the one before
        return BisectingKMeans(k=clusters, seed=seed, maxIter=20, minDivisibleClusterSize=2, featuresCol=features, predictionCol=to).fit(rows).transform(rows)
    models = [KMeans(k=clusters, seed=seed + i, maxIter=100, featuresCol=features, predictionCol=to).fit(rows) for i in range(STARTS)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(rows)


def divergence(rows: DataFrame, side: str = "side", bin: str = "bin", scale: float = 5.0, points: int = 25) -> dict[str, float]:
    """mauve and frontier_integral of the histograms of two sides (0 and 1) over bins; a null bin is a bin.

    Only counts by bin reach the driver: a tenth of the smaller side's rows at most, where bins come from mauve().
    """
    counts = rows.groupBy(bin).agg(*(F.count_if(F.col(side) == k).alias(f"n{k}") for k in (0, 1))).orderBy(bin).select("n0", "n1").collect()
    both = np.array([tuple(r) for r in counts], float).reshape(-1, 2).T
    a, b = both / np.maximum(both.sum(1, keepdims=True), 1)
    return {"mauve": frontier_area(a, b, scale, points), "frontier_integral": frontier_integral(a, b)}


def mauve(
    p: DataFrame, q: DataFrame, vector: str = "embedding", clusters: int | None = None, scale: float = 5.0, points: int = 25, seed: int = 42, variance: float = 0.9, model: str | None = None
) -> dict:
    """MAUVE of two sets of vectors, generated and reference: joint histograms, KL frontier over mixtures, its area.

    Vectors are normalised and reduced to the principal components that hold `variance` of it;
    there is a cluster for every ten rows of the smaller set if `clusters` isn't given. mauve
    and frontier_integral to 4 places, n_generated, n_reference (rows with a vector) and
    featurize_model, the name given for what made the vectors. Without rows on both sides the
    two figures are None.
    """
    from pyspark.ml.feature import PCA, Normalizer, VectorSlicer
    from pyspark.ml.functions import array_to_vector

    both = p.select(vector).withColumn("side", F.lit(0)).unionByName(q.select(vector).withColumn("side", F.lit(1))).where(F.col(vector).isNotNull())
    rows = Normalizer(inputCol="v", outputCol="u").transform(both.withColumn("v", array_to_vector(F.transform(vector, lambda e: e.cast("double")))))
    sizes = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count("*").alias("n")).collect()}
    told = {"n_generated": sizes.get(0, 0), "n_reference": sizes.get(1, 0), "featurize_model": model}
    if not told["n_generated"] or not told["n_reference"]:
        return {"mauve": None, "frontier_integral": None, **told}
    clusters = clusters or max(2, round(min(sizes[0], sizes[1]) / 10))
    dims = len(rows.select(vector).first()[vector])
    if dims > 1:
        axes = PCA(k=dims, inputCol="u", outputCol="axes").fit(rows)
        held = int(np.searchsorted(np.cumsum(axes.explainedVariance.toArray()), variance)) + 1
        rows = VectorSlicer(inputCol="axes", outputCol="reduced", indices=list(range(min(held, dims)))).transform(axes.transform(rows)).drop("u").withColumnRenamed("reduced", "u")
    figures = divergence(quantise(rows, "u", clusters, seed=seed), scale=scale, points=points)
    return {**{k: round(v, 4) for k, v in figures.items()}, **told}


def _kl(x: np.ndarray, y: np.ndarray) -> float:
    on = x > 0
    return float((x[on] * np.log(x[on] / y[on])).sum())


def frontier_area(a: np.ndarray, b: np.ndarray, scale: float = 5.0, points: int = 25) -> float:
    """Mean area under the divergence curve of two histograms and under its mirror image."""
    curve = [(0.0, 1.0)]
    for w in np.linspace(1e-6, 1 - 1e-6, points):
        mid = w * a + (1 - w) * b
        curve.append((float(np.exp(-scale * _kl(b, mid))), float(np.exp(-scale * _kl(a, mid)))))
    curve.append((1.0, 0.0))

    def area(points: list[tuple[float, float]]) -> float:
        falling = sorted(points, key=lambda xy: (xy[0], -xy[1]))
        return float(np.trapezoid([y for _, y in falling], [x for x, _ in falling]))

    return (area(curve) + area([(y, x) for x, y in curve])) / 2


def frontier_integral(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the integral over w of w * KL(a | mix) + (1 - w) * KL(b | mix), mix = w * a + (1 - w) * b.

    In closed form each bin adds (p + q) / 2 - p * q * log(p / q) / (p - q), equal bins nothing.
    """
    mean, apart = (a + b) / 2, np.abs(a - b) > 1e-12
    both = apart & (a > 0) & (b > 0)
    out = np.where(apart, mean, 0.0)
    x, y = a[both], b[both]
    out[both] -= x * y * np.log(x / y) / (x - y)
    return float(out.sum())


def memorisation_summary(found: DataFrame, fuzz: str = "fuzz_ratio", run: str = "longest_common_chars", jac: str = "jaccard_5gram") -> DataFrame:
    """Exact and long matches, medians and maxima, and the verdict."""
    m, half = MEMORISATION, [0.5]
    exact, long = F.when(F.col(fuzz) == 100, 1), F.when(F.col(run) >= m["run_below"], 1)
    s = summaries(found, {"f": (fuzz, half), "j": (jac, half), "r": (run, half), "exact": (exact, half), "long": (long, half)})
    out = s.select(
        F.col("rows").alias("n"), F.col("exact.n").alias("n_exact"), F.col("long.n").alias("n_long"),
        F.col("f.q")[0].alias("fuzz_median"), F.col("f.max").alias("fuzz_max"), F.col("j.q")[0].alias("jaccard_median"), F.col("j.max").alias("jaccard_max"),
        F.col("r.q")[0].alias("run_median"), F.col("r.max").cast("int").alias("run_max"),
    )
    return out.withColumn("passed", (F.col("fuzz_median") < m["median_below"]) & (F.col("fuzz_max") < m["max_below"]) & (F.col("run_max") < m["run_below"]))


def side_by_side(base: DataFrame, tuned: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Full outer join of two summaries with the difference of each metric, null where one is missing."""
    b = base.select(key, *[F.col(m).alias(f"{m}_base") for m in metrics])
    t = tuned.select(key, *[F.col(m).alias(f"{m}_tuned") for m in metrics])
    return b.join(t, key, "full").select(key, *[c for m in metrics for c in (f"{m}_base", f"{m}_tuned")], *[F.round(F.col(f"{m}_tuned") - F.col(f"{m}_base"), 4).alias(f"{m}_delta") for m in metrics])
