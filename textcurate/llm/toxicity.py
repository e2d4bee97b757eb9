"""Toxicity scores over texts that a noisy-channel decoder has restored.

Spelling tricks (digits and signs for letters, letters set apart, letters repeated) turn a
word into a lattice of characters; a Viterbi search over it under a character trigram model
of the whole corpus gives the likeliest plain word. Words as written and words as restored
then count for a linear model over words and word beginnings, learnt from labelled rows.

Ordinary words pass through as they are: only words that show such a trick are decoded, in
training as in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import merge, pack
from .hashing import CHUNK, SPACE, U, batches, hash_words, mix, word_spans
from .runtime import lean, materialize

#: Labelled rows of either class that the classifier is fitted on at most (those of smallest id hash).
SAMPLE = 4000
#: Features of a smaller likelihood-ratio statistic say too little and stay out.
LEAST_RATIO = 12.0
PREFIXES = (4, 5, 6, 7, 8)
# What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
GAPS = ".-_*~"
COST_LEET, COST_GAP, COST_REPEAT = 0.7, 0.3, 0.5
#: Blanks at most between characters set apart.
BLANKS = 3

#: Longer words aren't remembered.
REMEMBERED = 64
#: By character: (letter or nothing, class, cost) of each way to read it.
WAYS = {chr(i): ((chr(i), i - 96, 0.0),) for i in range(97, 123)}
WAYS |= {c: tuple((x, ord(x) - 96, COST_LEET) for x in LEET.get(c, "")) + ((("", 0, COST_GAP),) if c in GAPS else ()) for c in {*LEET, *GAPS}}
NOTHING, REPEATED = (("", 0, 2.0),), (("", 0, COST_REPEAT),)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_NOT_LETTER = ~_LETTER
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_END_SIGN = np.zeros(256, bool)
_END_SIGN[[ord(c) for c in "0134578@$"]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in GAPS]] = True
_CLASS = np.zeros(256, np.int64)  # 0: no letter, 1 to 26: a to z, 27: other letters
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def trigram_counts(buf: np.ndarray) -> np.ndarray:
    c = _CLASS[buf]
    return np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28**3) if len(c) > 2 else np.zeros(28**3, np.int64)


class Decoder:
    """Viterbi search over a word's character lattice under trigram costs [a, b, c]."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(28, 28, 28).astype(np.float64)
        two, one = n.sum(0), n.sum((0, 1))
        p1 = (one + 1) / (one.sum() + 28)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (n + 20 * p2[None]) / (n.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).tolist()
        # letters more than two are never worth more than they cost: 0.4 each beyond a gap, against two changed trigrams
        self.most = 2 + int(2 * float(np.max(-np.log(p3))) / (COST_LEET - COST_GAP))
        self.short = lru_cache(100_000)(self._decode)

    def decode(self, word: str) -> str:
        """The likeliest plain word, in time and memory linear in its length; only short words are remembered."""
        return self.short(word) if len(word) <= REMEMBERED else self._decode(word)

    def _decode(self, word: str) -> str:
        cost, plain = self.cost, []  # plain: what all ways that are left have in common
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before, run = "", 0
        for ch in word:
            run = run + 1 if ch == before else 1
            ways = WAYS.get(ch) or (((ch, 27, 0.0),) if ch.isalpha() else NOTHING)
            if run > self.most and len(ways) > 2 and ch in GAPS:
                continue  # more of a sign that may be a gap cost every way the same
            if run > 1:
                ways += REPEATED
            before = ch
            if len(beam) == 1 and len(ways) == 1:
                ((a, b),) = beam
                c, k, _ = ways[0]
                if c:
                    plain.append(c)
                    beam = {(b, k): (0.0, None)}
                continue
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, path) in beam.items():
                row = cost[a][b]
                for c, k, w in ways:
                    if c:
                        key, now, way = (b, k), total + w + row[k], (path, c)
                    else:
                        key, now, way = (a, b), total + w, path
                    if key not in nxt or now < nxt[key][0]:
                        nxt[key] = (now, way)
            beam = nxt
            if len(beam) == 1:
                ((key, (_, path)),) = beam.items()
                plain.append(_spelt(path))
                beam = {key: (0.0, None)}
        ends = [(total + cost[a][b][0], path) for (a, b), (total, path) in beam.items()]
        least = min(total for total, _ in ends)
        return "".join(plain) + min(_spelt(path) for total, path in ends if total == least)


def _spelt(path: tuple | None) -> str:
    """The characters of a chain of (chain before, character)."""
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def tricky_words(buf: np.ndarray) -> list[tuple[int, str]]:
    """(start, lower-case word) of the words that show a spelling trick."""
    s, e = word_spans(buf, SPACE)
    if not len(s):
        return []
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    letter = _LETTER[buf]
    before, after = np.concatenate([[False], letter[:-1]]), np.concatenate([letter[1:], [False]])
    flag = (_SIGN[buf] & after) | (_END_SIGN[buf] & before) | (_GAP[buf] & before & after)
    if len(low) > 2:
        flag[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] < 128)
    hits = np.searchsorted(s, np.flatnonzero(flag), "right") - 1
    # two letters or more that stand twice: ssttuuppiidd
    double = np.zeros(len(buf) + 1, np.int32)
    np.cumsum((low[1:] == low[:-1]) & letter[1:] & (low[1:] < 128), out=double[2:])
    hits = np.unique(np.concatenate([hits, np.flatnonzero(double[e] - double[s + 1] > 1)]))
    data = low.tobytes()
    out = [(int(s[i]), data[s[i] : e[i]].decode("utf-8", "replace")) for i in hits]
    # characters set apart on one line, blanks being free steps of the lattice: v 1 l  e
    single = (e - s == 1) & ((letter[s] & (buf[s] < 128)) | _END_SIGN[buf[s]])
    ends = np.cumsum(buf == 10)
    near = np.concatenate([[False], single[1:] & single[:-1] & (s[1:] - e[:-1] <= BLANKS) & (ends[s[1:]] == ends[s[:-1]])])
    edge = np.diff(np.concatenate([near[1:].astype(np.int8), [0]]), prepend=0)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        word = "".join(chr(low[i]) for i in s[a : b + 1])
        if any(c.isalpha() for c in word):
            out.append((int(s[a]), word))
    return out


def features(buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes): of the words, then of their beginnings of each length in PREFIXES."""
    s, e = word_spans(buf, _NOT_LETTER)
    yield s, mix(hash_words(buf, s, e))
    for k in PREFIXES:
        long = e - s >= k
        if long.any():
            yield s[long], mix(hash_words(buf, s[long], s[long] + k) + U(k))


def document_features(texts, decoder: Decoder | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, text numbers, feature hashes, texts) of batches; a text has a feature at most once."""
    for first, last, buf, bounds in batches(texts, CHUNK):
        docs, hashes = [], []
        for s, h in features(buf):
            docs.append(np.searchsorted(bounds, s, "right") - 1)
            hashes.append(h)
        if decoder is not None:
            tricky = tricky_words(buf)
            own = np.searchsorted(bounds, [x[0] for x in tricky], "right") - 1 if tricky else []
            plain = [decoder.decode(w).encode() + b" " for _, w in tricky]
            if plain:
                again, at = np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in plain])])
                for s, h in features(again):
                    docs.append(np.asarray(own)[np.searchsorted(at, s, "right") - 1])
                    hashes.append(h)
        yield first, np.concatenate(docs), np.concatenate(hashes), last - first


def _distinct(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.empty(0, bool)
    return d[keep], h[keep]


class Model:
    def __init__(self, trigrams: np.ndarray, hashes: np.ndarray, weights: np.ndarray, fit: np.ndarray):
        self.trigrams, self.hashes, self.weights, self.fit = trigrams, hashes, weights, fit
        self._decoder: Decoder | None = None

    def __getstate__(self):
        return self.__dict__ | {"_decoder": None}

    def inputs(self, texts) -> Iterator[tuple[int, np.ndarray]]:
        """(first text, [1, log of the summed weights, largest weight] of each text) of batches."""
        self._decoder = self._decoder or Decoder(self.trigrams)
        for first, d, h, n in document_features(texts, self._decoder):
            x = np.zeros((n, 3))
            x[:, 0] = 1
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                d, h = _distinct(d[hit], at[hit])
                np.add.at(x[:, 1], d, self.weights[h])
                np.maximum.at(x[:, 2], d, self.weights[h])
            x[:, 1] = np.log1p(x[:, 1])
            yield first, x


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (y - p) - ridge * np.r_[0, b[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag(np.r_[1e-6, np.ones(x.shape[1] - 1)])
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 3, out: int = 1) -> Model:
    """Fit on labelled rows of training folds; the trigram model counts every row of documents.

    At most `sample` rows of each class, those whose id hashes lowest, are used: seven of ten
    to weigh features, the rest to fit the score, whose intercept follows the classes' true
    shares. Rows of one id are one each. Labels are 0 or 1; null ids or labels are left out; an id with several labels
    takes their mean, 0.5 and above being 1. Without both classes every score is the share.
    """
    spark = documents.sparkSession
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != out)
        .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = {r["doc_id"]: (y, r["h"] % 10 < 7) for y in (0, 1) for r in known.where(F.col("y") == y).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).collect()}
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(parts):
        total = np.zeros(28**3, np.int64)
        for b in parts:
            for _, _, buf, _ in batches(b.column(0)):
                total += trigram_counts(buf)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    trigrams = np.zeros(28**3, np.int64)
    for r in rows.select("text").mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 28**3 rows at most
        trigrams[r["cell"]] = r["n"]
    picked = spark.createDataFrame([(i, y, fit) for i, (y, fit) in chosen.items()], "doc_id long, y int, fit boolean")  # at most 2 * sample rows
    own = materialize(rows.join(F.broadcast(picked), "doc_id").select("y", "fit", "text"), "toxicity-sample")
    buckets = 16

    def weigh_features(parts):
        decoder = Decoder(trigrams)
        for b in parts:
            y = b.column(0).to_numpy()
            for first, d, h, n in document_features(b.column(1), decoder):
                d, h = _distinct(d, h)
                k, back = np.unique(h, return_inverse=True)
                pos = np.bincount(back, y[first + d], len(k))
                neg = np.bincount(back, minlength=len(k)) - pos
                part = (k >> U(60)).astype(int)
                cuts = np.searchsorted(part, np.arange(buckets + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(buckets), pa.int32()), pa.array([pack(k[a:e], pos[a:e], neg[a:e]) for a, e in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["bucket", "blob"]
                )

    n_rows = {(r["y"], r["fit"]): r["n"] for r in own.groupBy("y", "fit").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n_rows.get((1, True), 0), n_rows.get((0, True), 0)

    def gather(table: pa.Table) -> pa.Table:
        k, (pos, neg) = merge([x.as_py() for x in table.column("blob")])
        weight, ratio = weigh(pos, neg, n_pos, n_neg)
        keep = (weight > 0) & (ratio >= LEAST_RATIO)
        return pa.table({"hash": pa.array(k[keep].view(np.int64)), "weight": pa.array(weight[keep])})

    features_ = own.where("fit").select("y", "text").mapInArrow(lean(weigh_features), "bucket int, blob binary")
    found = features_.groupBy("bucket").applyInArrow(gather, "hash long, weight double").toArrow()  # of a sample of bounded size
    k, w = found["hash"].to_numpy().view(U), found["weight"].to_numpy()
    order = np.argsort(k)
    model = Model(trigrams, k[order], w[order], np.zeros(3))

    def inputs(parts):
        for b in parts:
            y = b.column(0).to_numpy()
            for first, x in model.inputs(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(y[first : first + len(x)], pa.int32()), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["y", "a", "b"])

    fitted = np.array([tuple(r) for r in own.where("not fit").select("y", "text").mapInArrow(lean(inputs), "y int, a double, b double").collect()]).reshape(-1, 3)  # of the sample
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    prior = np.log((share + 1e-6) / (1 - share + 1e-6))
    y = fitted[:, 0]
    if 0 < y.sum() < len(y):
        fit = _logistic(np.column_stack([np.ones(len(y)), fitted[:, 1:]]), y)
        fit[0] += prior - np.log(y.mean() / (1 - y.mean()))
    else:
        fit = np.array([prior, 0, 0])
    model.fit = fit
    return model


def weigh(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, likelihood-ratio statistic) of features by the documents of either class that hold them."""
    pos, neg = pos.astype(np.float64), neg.astype(np.float64)
    weight = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    both, n = pos + neg, max(1, n_pos + n_neg)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    ratio = 2 * (part(pos, both * n_pos / n) + part(neg, both * n_neg / n) + part(n_pos - pos, (n - both) * n_pos / n) + part(n_neg - neg, (n - both) * n_neg / n))
    return weight, ratio


def score(documents: DataFrame, model: Model, least: float = 0.7, fold: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null text: as empty. A null id is not held out.

    Map-only; repeated rows get equal scores; further columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        for b in parts:
            p = np.empty(b.num_rows)
            for first, x in shared.value.inputs(b.column(2)):
                p[first : first + len(x)] = 1 / (1 + np.exp(-np.clip(x @ shared.value.fit, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p), pa.array((p >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == out, F.lit(False)).alias("held_out")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def reject(documents: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of documents that score below `least`, columns as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts):
        values = texts.astype(object).where(texts.notna(), None).tolist()
        p = np.empty(len(values))
        for first, x in shared.value.inputs(values):
            p[first : first + len(x)] = 1 / (1 + np.exp(-np.clip(x @ shared.value.fit, -500, 500)))
        return type(texts)(p)

    return documents.where(toxicity("text") < least)
