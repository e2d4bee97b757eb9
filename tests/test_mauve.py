"""MAUVE as a whole on vectors whose clusters are known, against the formula on the true shares."""

import random

import numpy as np
import pytest

from textcurate.operators import evaluation as E


def vectors(spark, shares, n, seed):
    """n vectors around the unit vectors of as many blobs, dealt by exact shares."""
    rng, rows = random.Random(seed), []
    for blob, share in enumerate(shares):
        for _ in range(round(share * n)):
            rows.append(([float(k == blob) + rng.gauss(0, 0.01) for k in range(len(shares))],))
    return spark.createDataFrame(rows, "embedding array<double>")


def by_formula(a, b):
    """Twice over: the area by fine steps between the points, the integral by the midpoint rule."""
    a, b = np.array(a), np.array(b)
    kl = lambda x, y: sum(p * np.log(p / q) for p, q in zip(x, y) if p > 0)
    curve = [(0.0, 1.0), (1.0, 0.0)]
    for k in range(25):
        w = 1e-6 + k * (1 - 2e-6) / 24
        m = w * a + (1 - w) * b
        curve.append((np.exp(-5 * kl(b, m)), np.exp(-5 * kl(a, m))))

    def area(points):
        points = sorted(points, key=lambda t: (t[0], -t[1]))
        return sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(points, points[1:]))

    steps = 20_000
    whole = 0.0
    for k in range(steps):
        w = (k + 0.5) / steps
        m = w * a + (1 - w) * b
        whole += 2 * (w * kl(a, m) + (1 - w) * kl(b, m)) / steps
    return (area(curve) + area([(y, x) for x, y in curve])) / 2, whole


@pytest.mark.parametrize("p, q", [([0.5, 0.3, 0.2, 0.0], [0.1, 0.3, 0.2, 0.4]), ([0.25] * 4, [0.25] * 4), ([0.5, 0.5, 0.0, 0.0], [0.0, 0.0, 0.5, 0.5])])
def test_mauve_of_known_clusters(spark, p, q):
    got = E.mauve(vectors(spark, p, 40, 1), vectors(spark, q, 60, 2), variance=0.999, model="blobs")  # 40 / 10 clusters
    area, whole = by_formula(p, q)
    assert got == {"mauve": pytest.approx(area, abs=2e-4), "frontier_integral": pytest.approx(whole, abs=2e-4), "n_generated": 40, "n_reference": 60, "featurize_model": "blobs"}


def test_many_clusters_are_halved(spark, monkeypatch):
    p, q = [0.5, 0.3, 0.2, 0.0], [0.1, 0.3, 0.2, 0.4]
    monkeypatch.setattr(E, "FLAT", 3)
    got = E.mauve(vectors(spark, p, 40, 1), vectors(spark, q, 60, 2), clusters=4, variance=0.999)
    assert got["mauve"] == pytest.approx(by_formula(p, q)[0], abs=2e-4)


def test_mauve_without_rows(spark):
    some, none = vectors(spark, [0.5, 0.5], 10, 1), vectors(spark, [], 0, 1)
    assert E.mauve(some, none) == {"mauve": None, "frontier_integral": None, "n_generated": 10, "n_reference": 0, "featurize_model": None}


def test_hashed_trigrams():
    v = E.hashed_trigrams(["abcabc", "abc", "ab", None, "é😀x" * 50, "abcabc"], 64)
    assert v.shape == (6, 64) and v.sum(1).tolist() == [4, 1, 0, 0, 148, 4]
    assert (v[0] == v[5]).all() and (v[0] >= v[1]).all() and np.count_nonzero(v[4]) == 3
