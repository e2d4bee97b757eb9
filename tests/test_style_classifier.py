"""style_classifier: every row is predicted, every language is a class, the vocabulary is not cut."""

import math
from collections import Counter

import pytest

from textcurate.operators import evaluation as E
from textcurate.plans import catalogue


def test_style_classifier_takes_every_row(spark, tmp_path, monkeypatch):
    said = {"en": "the house and the garden", "de": "das haus und der garten", "fr": "la maison et le jardin"}
    rows = [(i, lang, f"{text} {i}") for i in range(12) for lang, text in [list(said.items())[i // 2 % 3]]]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    features, start = [], E.StyleClassifier.__init__

    def init(self, *a, **b):
        start(self, *a, **b)
        features.append(self.features)

    monkeypatch.setattr(E.StyleClassifier, "__init__", init)
    got = {r["lang"]: r for r in catalogue.style_classifier(spark, str(tmp_path)).collect()}
    assert {k: r["n"] for k, r in got.items()} == {k: 4 for k in said}
    assert all(r[f"to_{k}"] == 1.0 for k, r in got.items())
    assert set(features) == {50_000}


@pytest.mark.parametrize("distinct", [65_535, 5])
def test_grams_of_texts_by_plain_counts(monkeypatch, distinct):
    """Runs of texts at once, and text by text where they hold too many characters."""
    monkeypatch.setattr(E, "DISTINCT", distinct)
    texts = [" ".join(f"W\u00d6rd{i * j % 37}{' ' if j % 5 else ' '}A b" for j in range(i % 9)) for i in range(120)] + [None, "", " ", "a", "\U0001f600 aa aaaa", "ab\U0001f600\U0010ffff"]
    plain = []
    for t in texts:
        plain.append(Counter())
        for w in (t or "").lower().split():
            plain[-1].update(E.word_grams(w))
    times, held = sum(plain, Counter()), Counter(g for own in plain for g in own)
    for counted in (2_000_000, 50):
        monkeypatch.setattr(E, "COUNTED", counted)
        parts, summed = list(E.count_grams(texts)), [Counter(), Counter()]
        for grams, *counts in parts:
            for to, c in zip(summed, counts):
                to.update(dict(zip(grams, c.tolist())))
        assert summed == [times, held] and (distinct == 5 or len(parts) == 3 or counted == 50)

    weights = {g: (i, 1 + i / 7) for i, g in enumerate(sorted(times)[::3])}
    monkeypatch.setattr(E, "WEIGHED", 300)
    got, sent = [], list(E.weigh_grams(texts, weights))
    for n, ends, indices, values in sent:
        assert n == len(ends) and len(indices) == len(values) == ends[-1] < 1800  # no batch holds all
        got += [dict(zip(indices[a:b].tolist(), values[a:b].tolist())) for a, b in zip([0, *ends[:-1]], ends)]
    assert len(sent) > 2 and len(got) == len(texts) and all(list(v) == sorted(v) for v in got)
    for own, vector in zip(plain, got):
        raw = {weights[g][0]: weights[g][1] * (1 + math.log(n)) for g, n in own.items() if g in weights}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        assert vector == pytest.approx({i: x / norm for i, x in raw.items()})
    assert [x[0] for x in E.weigh_grams(["", None, "a"], {})] == [3] and list(E.weigh_grams([], weights)) == []
