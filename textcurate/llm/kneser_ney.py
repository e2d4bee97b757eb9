"""Interpolated modified Kneser-Ney model, counted in Spark and scored from mapped arrays.

Counting: tasks turn texts into 64-bit word hashes and send sorted, pre-aggregated blocks of
(hash, count), cut by hash range, through one shuffle; each range is merged into a sorted
array file. A word's id is its rank over all files. Trigrams of ids go through a second shuffle,
cut by a mixed hash of their last two words, so that a frequent word's trigrams spread and a
bigram's left contexts meet in one merge: it writes the bigrams with their continuation counts
and the trigrams with theirs. Sums by one-word context and by word, and those by two-word
context of the stored trigrams, are merged in two last shuffles, by ranges again. Workers map
the files and never load them whole.

Trigrams that occur `least` times are stored (2, as is usual for the highest order); the mass
of the others goes to the bigram level of their context, and all of them count for discounts
and for the continuation counts of bigrams. Bigrams that begin a text have no left context,
so their occurrences count instead. With order 2 there are no trigrams and bigrams count by
their occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import bucket_of, map_array, merge, pack, Packed, packed_size, save_array, SortedShards, U, unpack, within_bucket
from .hashing import mix, unmix, words_of
from .runtime import lean, materialize, work_dir

#: Words and trigrams that a task gathers before it sorts and sends them.
GATHER, GATHER_GRAMS = 1 << 21, 1 << 21
#: Distinct keys that a merge should have about, which sets the number of ranges.
RANGE = 1 << 20
#: Words of an id range, whose statistics all ranges send to one merge.
ID_RANGE = 1 << 18
END = U(0x9E3779B97F4A7C15)
LOW = U(0xFFFFFFFF)


def _streams(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(first row, hashes with an END behind each text, bounds of texts, batch)."""
    for b in batches:
        for first, w, at in words_of(b.column(column)):
            n = len(at) - 1
            ends = at[1:] + np.arange(n)
            out = np.empty(len(w) + n, U)
            keep = np.ones(len(out), bool)
            keep[ends] = False
            out[keep], out[ends] = w, END
            yield first, out, np.concatenate([[0], ends + 1]), b


def _cut(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that sorted hashes fall into, bounds of their keys)."""
    bucket = bucket_of(keys, buckets)
    which = np.unique(bucket)
    return which, np.searchsorted(bucket, np.append(which, buckets))


def _word_blocks(hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    k, c = np.unique(hashes, return_counts=True)
    which, cuts = _cut(k, buckets)
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([pack(k[a:e], c[a:e]) for a, e in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["bucket", "blob"])


def _gram_blocks(pairs: np.ndarray, before: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blocks of distinct mixed pairs, each with the distinct words before it and their counts."""
    order = np.lexsort((before, pairs))
    p, u = pairs[order], before[order]
    del order
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (u[1:] != u[:-1])])
    first = np.flatnonzero(new)
    p, u, c = p[first], u[first], np.diff(np.append(first, len(p)))
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    k, n = p[first], np.diff(np.append(first, len(p)))
    at = np.append(first, len(p))
    which, cuts = _cut(k, buckets)
    blobs, sizes = [], []
    for a, e in zip(cuts[:-1], cuts[1:]):
        x, y = at[a], at[e]
        raw = pack(np.diff(k[a:e], prepend=U(0)).astype(U), n[a:e]) + u[x:y].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + c[x:y].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        sizes.append(len(raw))
        blobs.append(pa.compress(raw, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "size", "blob"])


def _grams(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, word before, count) rows of a block."""
    k, (n,) = unpack(raw)
    at, m = packed_size(len(k), n), int(n.sum())
    u, c = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m, at + x).reshape(4, m).T).view("<u4").ravel() for x in (0, 4 * m))
    return np.repeat(np.cumsum(k), n), u, c


class Counts:
    """What the driver keeps of a model: file names, sizes of ranges and a few sums."""

    def __init__(self, folder: str, order: int, least: int):
        self.folder, self.order, self.least = folder, order, least
        self.words: list[int] = []
        self.pairs: list[int] = []
        self.trigrams: list[int] = []
        self.contexts: list[int] = []
        self.tokens = 0
        self.trigram_discounts = self.pair_discounts = self.word_discounts = (0.0, 0.0, 0.0)
        self.cont_total = 0
        self.cont_types = (0, 0, 0)
        self.present: set[tuple[int, int]] = set()


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts 1 to 4 (Chen and Goodman), kept within [0, k]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return tuple(min(max(x, 0.05), k) for k, x in enumerate(d, 1))


def trigram_key(pairs: np.ndarray, before: np.ndarray) -> np.ndarray:
    """48 bits of the hash of a mixed pair and the word before it."""
    with np.errstate(over="ignore"):
        return mix(pairs + mix(before.astype(U) + END)) >> U(16)


def train(texts: DataFrame, text: str = "text", order: int = 3, least: int = 2) -> Counts:
    """Counts over every row of `texts`; null is an empty text, which is one END token."""
    spark = texts.sparkSession
    folder = work_dir(spark, "kneser-ney")
    model = Counts(folder, order, least)
    source = texts.select(F.col(text).alias("text"))
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * source.rdd.getNumPartitions())

    def count_words(batches):
        held, size = [], 0
        for _, w, _, _ in _streams(batches, 0):
            held.append(w)
            size += len(w)
            if size >= GATHER:
                yield _word_blocks(np.concatenate(held), ranges)
                held, size = [], 0
        if size:
            yield _word_blocks(np.concatenate(held), ranges)

    def merge_words(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        keys, (c,) = merge([x.as_py() for x in table.column("blob")])
        save_array(folder, f"words-{b}.npy", keys)
        save_array(folder, f"word-counts-{b}.npy", c if len(c) and c.max() >= 1 << 32 else c.astype(np.uint32))
        return pa.table({"bucket": pa.array([b], pa.int32()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64()), "texts": pa.array([int(c[keys == END].sum())], pa.int64())})

    found = source.mapInArrow(lean(count_words), "bucket int, blob binary").groupBy("bucket").applyInArrow(merge_words, "bucket int, types long, tokens long, texts long")
    model.words, n_texts = [0] * ranges, 0
    for r in found.collect():  # a row for each range
        model.words[r["bucket"]] = r["types"]
        model.tokens += r["tokens"]
        n_texts += r["texts"]
    check_ids(sum(model.words))
    begin, words, gram_ranges = sum(model.words), model.words, max(8, -(-model.tokens // RANGE))

    def count_grams(batches):
        ids = SortedShards(folder, "words", words)
        held, size = [], 0
        for _, w, at, _ in _streams(batches, 0):
            w = word_ids(ids, w)
            v, u = contexts(w, at, begin)
            held.append((mix(pair(v, w)), u.astype(np.uint32) if order > 2 else np.zeros(len(w), np.uint32)))
            size += len(w)
            if size >= GATHER_GRAMS:
                yield _gram_blocks(*(np.concatenate(x) for x in zip(*held)), gram_ranges)
                held, size = [], 0
        if size:
            yield _gram_blocks(*(np.concatenate(x) for x in zip(*held)), gram_ranges)

    def merge_grams(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        p, u, c = (np.concatenate(x) for x in zip(*(_grams(pa.decompress(x.as_py(), n, "zstd", asbytes=True)) for x, n in zip(table["blob"], table["size"].to_pylist()))))
        order_ = np.lexsort((u, p))
        p, u, c = p[order_], u[order_], c[order_].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (u[1:] != u[:-1])]))
        p, u, c = p[first], u[first], np.add.reduceat(c, first)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        pairs, raw, n = p[first], np.add.reduceat(c, first), np.diff(np.append(first, len(p)))
        plain = unmix(pairs)
        context, word = plain >> U(32), plain & LOW
        n = np.where(context == begin, raw, n) if order > 2 else raw
        Packed.save(folder, "pairs", b, within_bucket(pairs, np.full(len(pairs), b), gram_ranges), n=n, raw=raw)
        kinds, buckets, blobs = [], [], []

        def send(kind, keys, parts, values):
            """Sums of the values by key, cut by the parts that sorted keys fall into."""
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            sums = [np.add.reduceat(v[order], first) if len(first) else v for v in values]
            keys = keys[first]
            part = parts(keys)
            which = np.unique(part)
            cuts = np.searchsorted(part, np.append(which, part[-1] + 1)) if len(part) else [0]
            for i, a, e in zip(which, cuts[:-1], cuts[1:]):
                kinds.append(kind)
                buckets.append(int(i))
                blobs.append(pack(keys[a:e], *(s[a:e] for s in sums)))

        def by_id(ids):
            return (ids // U(ID_RANGE)).astype(np.int64)

        one = np.ones(len(n), np.int64)
        send(0, context, by_id, (n, (n == 1) * one, (n == 2) * one, (n > 2) * one))
        send(1, word, by_id, (one,))
        kept = np.flatnonzero(c >= least) if order > 2 else np.empty(0, np.int64)
        if len(kept):
            own, k, cc = mix(pair(u[kept], unmix(p[kept]) >> U(32))), trigram_key(p[kept], u[kept]), c[kept]
            send(3, own, lambda keys: bucket_of(keys, gram_ranges), (cc, (cc == 1) * 1, (cc == 2) * 1, (cc > 2) * 1))
            by = np.argsort(k, kind="stable")
            Packed.save(folder, "trigrams", b, k[by], n=cc[by])
        kinds.append(2)
        buckets.append(b)
        counts = [(x == k).sum() for x in (n, c) for k in (1, 2, 3, 4)]
        blobs.append(np.array([len(pairs), len(kept), *counts], np.int64).tobytes())
        return pa.table({"kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    merged = materialize(
        source.mapInArrow(lean(count_grams), "bucket int, size long, blob binary").groupBy("bucket").applyInArrow(merge_grams, "kind int, bucket int, blob binary"), "gram-statistics"
    )
    model.pairs, model.trigrams, model.contexts = ([0] * gram_ranges for _ in range(3))
    n = np.zeros(8, np.int64)
    for r in merged.where("kind = 2").collect():  # a row for each range
        size, kept, *counts = np.frombuffer(bytes(r["blob"]), np.int64)
        model.pairs[r["bucket"]], model.trigrams[r["bucket"]] = int(size), int(kept)
        n += counts
    model.pair_discounts, model.trigram_discounts = discounts(n[:4].tolist()), discounts(n[4:].tolist())
    sizes, d3 = model.pairs, model.trigram_discounts

    def merge_sums(table: pa.Table) -> pa.Table:
        kind, b = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, sums = merge([x.as_py() for x in table.column("blob")])
        if kind == 3:
            key = within_bucket(keys, np.full(len(keys), b), gram_ranges)
            _, total = Packed(folder, "pairs", sizes, ("raw",)).get(np.full(len(keys), b), key)
            total[keys == mix(pair(np.array([begin]), np.array([begin])))[0]] = n_texts  # before a text's first word
            # what the stored trigrams leave to the bigrams, of a mass of 1
            share = 1 - (sums[0] - sum(d * s for d, s in zip(d3, sums[1:]))) / total
            Packed.save(folder, "contexts", b, key, total=total.astype(np.uint32) if not len(total) or total.max() < 1 << 32 else total, share=share)
            stats = [len(keys)] + [0] * 5
        else:
            at = (keys - U(b * ID_RANGE)).astype(np.int64)
            for name, s in zip(("total", "n1", "n2", "n3") if kind == 0 else ("left",), sums):
                dense = np.zeros(ID_RANGE, np.uint32 if s.max() < 1 << 32 else np.int64)
                dense[at] = s
                save_array(folder, f"{name}-{b}.npy", dense)
            s = sums[0] if kind else np.empty(0, np.int64)
            stats = [int(s.sum()), *(int((s == k).sum()) for k in (1, 2, 3, 4)), int((s > 2).sum())]
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([b], pa.int32()), "stats": pa.array([stats], pa.list_(pa.int64()))})

    rows = merged.where("kind <> 2").groupBy("kind", "bucket").applyInArrow(merge_sums, "kind int, bucket int, stats array<long>").collect()  # rows of bounded size, three for each range
    stats = np.sum([r["stats"] for r in rows if r["kind"] == 1] or [[0] * 6], axis=0)
    model.cont_total = int(stats[0])
    model.word_discounts = discounts(stats[1:5].tolist())
    model.cont_types = (int(stats[1]), int(stats[2]), int(stats[5]))
    for r in rows:
        if r["kind"] == 3:
            model.contexts[r["bucket"]] = r["stats"][0]
        else:
            model.present.add((r["kind"], r["bucket"]))
    return model


def check_ids(words: int) -> None:
    """Pairs hold ids of 32 bits, one of which stands for a text's beginning and one for unknown words."""
    if words >= (1 << 32) - 1:
        raise OverflowError(f"{words} distinct words: more than ids of 32 bits can name")


def word_ids(shards: SortedShards, hashes: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(hashes, return_inverse=True)
    return shards.find(distinct)[back]


def contexts(ids: np.ndarray, at: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; `begin` before a text's first."""
    v, u = np.empty_like(ids), np.empty_like(ids)
    v[1:] = ids[:-1]
    v[at[:-1]] = begin
    u[1:] = v[:-1]
    u[at[:-1]] = begin
    return v, u


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(U) << U(32)) | (second.astype(U) & LOW)


class Scorer:
    """Log probabilities from a model's mapped files."""

    def __init__(self, model: Counts):
        m = self.model = model
        f = m.folder
        self.types = sum(m.words)
        self.words = SortedShards(f, "words", m.words)
        self.counts: dict[int, np.ndarray] = {}
        self.pairs = Packed(f, "pairs", m.pairs, ("n",))
        self.trigrams = Packed(f, "trigrams", m.trigrams, ("n",))
        self.contexts = Packed(f, "contexts", m.contexts, ("total", "share"))
        self.kinds = {"total": 0, "n1": 0, "n2": 0, "n3": 0, "left": 1}
        self.dense: dict[tuple[str, int], np.ndarray] = {}

    def at(self, name: str, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.float64)
        part = ids // ID_RANGE
        for p in np.unique(part):
            if (self.kinds[name], p) in self.model.present:
                if (name, p) not in self.dense:  # files are mapped as they are needed
                    self.dense[name, p] = map_array(self.model.folder, f"{name}-{p}.npy")
                sel = part == p
                out[sel] = self.dense[name, p][ids[sel] - p * ID_RANGE]
        return out

    def occurrences(self, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ranks), np.int64)
        which = np.searchsorted(self.words.offsets, ranks, "right") - 1
        for b in np.unique(which[ranks >= 0]):
            sel = (which == b) & (ranks >= 0)
            if b not in self.counts:
                self.counts[b] = map_array(self.model.folder, f"word-counts-{b}.npy")
            out[sel] = self.counts[b][ranks[sel] - self.words.offsets[b]]
        return out

    def find(self, table: Packed, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Packed.get of mixed pairs in any order."""
        distinct, back = np.unique(pairs, return_inverse=True)
        n = len(table.sizes)
        bucket = bucket_of(distinct, n)
        return tuple(x[back] for x in table.get(bucket, within_bucket(distinct, bucket, n)))

    def tokens(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count in training, log10 of the base estimate, log10 of the model) of each token."""
        m = self.model
        distinct, back = np.unique(hashes, return_inverse=True)
        ids = self.words.find(distinct)
        known = ids >= 0
        c = self.occurrences(ids)
        left = np.zeros(len(ids))
        left[known] = self.at("left", ids[known])
        total = max(m.cont_total, 1)
        spare = sum(x * y for x, y in zip(m.word_discounts, m.cont_types)) / total if m.cont_total else 1.0
        low = cut(left, m.word_discounts) / total + spare / (self.types + 1)
        base = np.log10((c + 1) / (m.tokens + 1 * (self.types + 1)))
        w = ids[back]
        p = low[back]
        v, u = contexts(w, at, self.types)
        seen = v >= 0
        one, back1 = np.unique(v[seen], return_inverse=True)
        tot = self.at("total", one)
        gamma = sum(d * self.at(name, one) for d, name in zip(m.pair_discounts, ("n1", "n2", "n3"))) / np.maximum(tot, 1)
        gamma[tot == 0] = 1.0
        share, mass = np.ones(len(w)), np.ones(len(w))
        share[seen], mass[seen] = gamma[back1], np.maximum(tot, 1)[back1]
        both = np.flatnonzero(seen & (w >= 0))
        keys = mix(pair(v[both], w[both]))
        met, count = self.find(self.pairs, keys)
        p *= share
        p[both] += cut(count, m.pair_discounts) / mass[both]
        if m.order > 2:
            two = np.flatnonzero(seen & (u >= 0))
            held, total, share = self.find(self.contexts, mix(pair(u[two], v[two])))
            p[two[held]] *= share[held]
            mass = np.zeros(len(w))
            mass[two[held]] = total[held]
            may = met & (mass[both] > 0)
            tokens, keys = both[may], keys[may]
            bucket, key = bucket_of(keys, len(m.pairs)), trigram_key(keys, u[tokens])
            order = np.lexsort((key, bucket))
            _, count = self.trigrams.get(bucket[order], key[order])
            p[tokens[order]] += cut(count, m.trigram_discounts) / mass[tokens[order]]
        return c[back], base[back], np.log10(p)


def cut(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(int)], 0)


def score(documents: DataFrame, held_out, model: Counts) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row."""

    def run(batches):
        s = Scorer(model)
        held: dict[str, list] = {}
        for first, w, at, b in _streams(batches, 2):
            c, base, p = s.tokens(w, at)
            n = len(at) - 1
            size = np.diff(at)
            total = np.add.reduceat(p, at[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(size, pa.int64()),
                    pa.array(np.add.reduceat((c > 0).astype(np.int64), at[:-1]), pa.int64()), pa.array(np.full(n, s.model.tokens), pa.int64()),
                    pa.array(np.add.reduceat(base, at[:-1])), pa.array(total), pa.array(10 ** np.minimum(-total / size, 300)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_documents(documents: DataFrame, fold: int = 7, out: int = 2, order: int = 3, least: int = 2) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod fold is not `out`, score all rows.

    order is 2 or 3; trigrams that occur `least` times are stored. A null doc_id trains. Null and empty texts have the one token END. Words that training
    lacks share one unknown class. With nothing to train on, both scores are those of an
    empty model. Repeated rows count as often as they occur; further columns are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == out, F.lit(False))
    return score(documents, held_out, train(documents.where(~held_out), order=order, least=least))
