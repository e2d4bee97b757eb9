import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textcurate.llm import arrays, lookup
from textcurate.llm import kneser_ney as kn
from textcurate.llm.arrays import Packed, bucket_of, within_bucket
from textcurate.llm.hashing import mix, unmix


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end>"]


def cut(x, d):
    return x - (d[min(x, 3) - 1] if x else 0)


def disc(counts):
    return kn.discounts([sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)])


def brute(rows, order, least):
    """Scores by the model's definition, with dictionaries of words."""
    train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    big = Counter(p for t in train for p in zip(["<s>", *t], t))
    tri = Counter(p for t in train for p in zip(["<s>", "<s>", *t], ["<s>", *t], t))
    n, v = sum(c.values()), len(c)
    left = Counter(w for _, w in big)
    if order == 3:  # bigrams by the words before them, but those that begin a text
        types = Counter(x[1:] for x in tri)
        big = {x: k if x[0] == "<s>" else types[x] for x, k in big.items()}
    d3, d2, d1 = disc(tri), disc(big), disc(left)
    ctx, ctx2 = defaultdict(list), defaultdict(list)
    for (a, _), x in big.items():
        ctx[a].append(x)
    for (a, b, _), x in tri.items():
        ctx2[a, b].append(x)
    total = max(sum(left.values()), 1)
    types = [sum(x == 1 for x in left.values()), sum(x == 2 for x in left.values()), sum(x > 2 for x in left.values())]
    spare = sum(a * b for a, b in zip(d1, types)) / total if left else 1.0

    def p2(a, w):
        low = cut(left[w], d1) / total + spare / (v + 1)
        if a not in ctx:
            return low
        xs = ctx[a]
        return cut(big.get((a, w), 0), d2) / sum(xs) + sum(d2[min(x, 3) - 1] for x in xs) / sum(xs) * low

    def p3(a, b, w):
        xs = ctx2.get((a, b), [])
        if order == 2 or not xs:
            return p2(b, w)
        x = tri[a, b, w]
        return (cut(x, d3) if x >= least else 0) / sum(xs) + (1 - sum(cut(x, d3) for x in xs if x >= least) / sum(xs)) * p2(b, w)

    out = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        out.append((i, len(ws), sum(c[w] > 0 for w in ws), n, base, sum(math.log10(p3(a, b, w)) for a, b, w in zip(["<s>", "<s>", *ws], ["<s>", *ws], ws))))
    return out, [sum(p3(a, b, w) for w in [*c, "\0"]) for a, b in [*ctx2, ("never", "seen"), ("never", "the")]]


ROWS = [(i, "the cat sat on the mat The dog %d sat" % (i % 5) + " the the" * (i % 4)) for i in range(40)] + [
    (40, None), (41, ""), (None, "the dog"), (7, "the dog"), (7, "the dog"), (43, "é x " * 700),
]


@pytest.mark.parametrize(("rows", "order", "least"), [(ROWS, 3, 2), (ROWS, 3, 1), (ROWS, 2, 1), (ROWS[:1], 3, 2), ([], 3, 2)])
def test_scores_match_the_definition(spark, rows, order, least):
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    got = [tuple(r) for r in kn.score_documents(df, order=order, least=least).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    want, sums = brute(rows, order, least)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_packed_tables(tmp_path):
    g = np.random.default_rng(2)
    for buckets in (1, 8, 150):
        keys = np.unique(g.integers(0, 1 << 64, 5000, dtype=np.uint64))
        bucket = bucket_of(keys, buckets)
        counts = g.integers(1, 600, len(keys))
        sizes = []
        for b in range(buckets):
            own = bucket == b
            Packed.save(str(tmp_path), f"t{buckets}", b, within_bucket(keys[own], bucket[own], buckets), n=counts[own])
            sizes.append(int(own.sum()))
        assert (np.diff(within_bucket(keys, bucket, buckets).astype(np.float64))[np.diff(bucket) == 0] > 0).all() and within_bucket(keys, bucket, buckets).max() < 1 << 48
        asked = np.unique(np.concatenate([keys[::2], g.integers(0, 1 << 64, 3000, dtype=np.uint64)]))
        b = bucket_of(asked, buckets)
        found, n = Packed(str(tmp_path), f"t{buckets}", sizes, ("n",)).get(b, within_bucket(asked, b, buckets))
        want = dict(zip(keys.tolist(), counts.tolist()))
        assert [(bool(f), int(x)) for f, x in zip(found, n)] == [(k in want, want.get(k, 0)) for k in asked.tolist()]


def test_unmix():
    x = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert (unmix(mix(x)) == x).all() and (mix(unmix(x)) == x).all()


def test_counts_and_ids_beyond_32_bits():
    """Large counts keep their value, and more words than ids are an error instead of a mix-up."""
    keys = np.array([3, 9, 2**63 + 1], np.uint64)
    few, many = np.array([1, 7, 2**32 - 1]), np.array([2**32 + 5, 1, 2**40])
    blob = arrays.pack(keys, few, many)
    assert len(blob) == arrays.packed_size(3, few, many)
    got, (a, b) = arrays.unpack(blob)
    assert got.tolist() == keys.tolist() and a.tolist() == few.tolist() and b.tolist() == many.tolist()
    _, (c,) = arrays.merge([arrays.pack(keys, many), arrays.pack(keys, many)])
    assert c.tolist() == (2 * many).tolist()
    kn.check_ids(2**32 - 2)
    with pytest.raises(OverflowError):
        kn.check_ids(2**32 - 1)


def test_scaled_counts_keep_their_order():
    n = np.unique(np.concatenate([np.arange(1, 3000), 2 ** np.arange(12, 39), 3 * 2 ** np.arange(12, 38)]))
    s = lookup.scaled(n)
    assert (np.diff(s.astype(int)) >= 0).all() and (s[:128] == n[:128]).all() and s[-1] < 255
    assert (s > 1).tolist() == (n > 1).tolist() and len(set(lookup.scaled(2 ** np.arange(8, 38)).tolist())) == 30
