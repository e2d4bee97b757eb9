"""The toxicity model's weights, fit and scores against plain Python, and its decoder on very long words."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcurate.llm import toxicity


def features(text):
    """Distinct words and their beginnings, as bytes; the texts here show no spelling trick."""
    words = set(re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()))
    return {(w, 0) for w in words} | {(w[:k], k) for w in words for k in toxicity.PREFIXES if len(w) >= k}


def test_op8_weights_fit_and_scores(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choices("aeinrst", k=rng.randint(2, 5))) + "ov" for _ in range(60)]
    plain = [w for w in plain if not re.search(r"(.)\1", w)]
    rows, labels = [], []
    for i in range(400):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(3, 20)) + (rng.sample(["vile", "scum", "moron", "élan"], rng.randint(1, 2)) if toxic and rng.random() < 0.9 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "vile scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    known = [(i, t, y) for (i, t), (_, _, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 3 != 1]
    weighing_ids = {i for i, _, _ in known if hashes[i] % 10 < 7}
    weighing = [(features(t), y) for i, t, y in known if i in weighing_ids]
    n_pos, n = sum(y for _, y in weighing), len(weighing)
    weights = {}
    for f in set().union(*(f for f, _ in weighing)):
        a, b = (sum(f in own for own, y in weighing if y == side) for side in (1, 0))
        weight = math.log((a + 0.5) / (n_pos + 1)) - math.log((b + 0.5) / (n - n_pos + 1))
        cells = [(a, (a + b) * n_pos / n), (b, (a + b) * (n - n_pos) / n), (n_pos - a, (n - a - b) * n_pos / n), (n - n_pos - b, (n - a - b) * (n - n_pos) / n)]
        ratio = 2 * sum(seen * math.log(seen / expected) for seen, expected in cells if seen)
        if weight > 0 and ratio >= toxicity.LEAST_RATIO:
            weights[f] = weight
    assert len(weights) >= 8 and sorted(model.weights) == pytest.approx(sorted(weights.values()))

    def inputs(text):
        own = [weights[f] for f in features(text or "") if f in weights]
        return 1, math.log1p(sum(own)), max(own, default=0)

    fit = [(inputs(t), y) for i, t, y in known if i not in weighing_ids]
    shares = sum(y for _, _, y in known) / len(known), sum(y for _, y in fit) / len(fit)
    shift = math.log(shares[0] / (1 - shares[0])) - math.log(shares[1] / (1 - shares[1]))
    b = np.array(model.fit) - [shift, 0, 0]
    x, y = np.array([v for v, _ in fit]), np.array([v for _, v in fit])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ b))) - [0, b[1], b[2]]  # ridge of 1; zero at the optimum
    assert np.abs(slope).max() < 1e-4
    for r in toxicity.score(docs, model).collect():
        want = 1 / (1 + math.exp(-np.dot(inputs(dict(rows)[r.doc_id]), model.fit)))
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(want >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_op8_long_words_are_linear():
    text = " the idiot vile stupid apple " * 50
    decoder = toxicity.Decoder(toxicity.trigram_counts(np.frombuffer(text.encode(), np.uint8)))
    rng = random.Random(3)
    image = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    began = time.time()
    assert 800_000 < len(decoder.decode(image)) <= 1_000_000
    assert decoder.decode("*" * 1_000_000 + "b")[-1] == "b"
    assert time.time() - began < 5
    assert decoder.short.cache_info().currsize == 0
    for word in ("st" + "*" * 300 + "pid", "*" * 200 + "vile", "v1l3" + "*" * 150):  # beyond `most` signs nothing changes
        whole = toxicity.Decoder(toxicity.trigram_counts(np.frombuffer(text.encode(), np.uint8)))
        whole.most = 10**9
        assert decoder.decode(word) == whole.decode(word)
    cut = decoder.decode(image[:5000] + "*" + image[5000:10_000])
    assert cut.startswith(decoder.decode(image[:4000])[:3000])
