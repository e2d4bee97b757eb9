"""Exact quantiles by selection against sorted lists: skewed, tied, null and empty groups, and bounds that force several rounds."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from textcurate.operators import quantiles as Q

PROBS = [0.0, 0.25, 0.5, 0.77, 0.95, 1.0]


def cont(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)


def disc(values, p):
    return sorted(values)[max(math.ceil(p * len(values)) - 1, 0)]


def rows():
    rng = random.Random(2)
    out = [("hot", rng.gauss(0, 1)) for _ in range(6000)] + [("hot", 0.25)] * 3000  # a value that a third of the group has
    out += [("long", rng.paretovariate(0.4)) for _ in range(3000)]
    out += [("few", float(rng.randrange(4))) for _ in range(500)] + [("one", 5.0), ("none", None), (None, 1.5), (None, 2.5), ("few", None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bound", [10, 150, 100_000])
@pytest.mark.parametrize("kind", ["cont", "disc"])
def test_quantiles_against_sorted_lists(spark, bound, kind):
    data = rows()
    df = spark.createDataFrame([(g, v, None if v is None else -2 * v) for g, v in data], "g string, v double, w double").repartition(7)
    found = Q.summaries(df, {"v": ("v", PROBS), "w": (F.col("w") + 1, [0.5])}, ["g"], disc=kind == "disc", bound=bound)
    got = {r["g"]: r for r in found.collect()}
    one = disc if kind == "disc" else cont
    assert set(got) == {"hot", "long", "few", "one", "none", None}
    for g, r in got.items():
        own = [v for x, v in data if x == g and v is not None]
        assert (r["rows"], r["v"]["n"]) == (sum(x == g for x, _ in data), len(own))
        if not own:
            assert r["v"]["q"] is None and r["v"]["mean"] is None
            continue
        assert r["v"]["q"] == pytest.approx([one(own, p) for p in PROBS])
        assert r["w"]["q"] == pytest.approx([one([1 - 2 * v for v in own], 0.5)])
        assert (r["v"]["min"], r["v"]["max"]) == (min(own), max(own)) and r["v"]["mean"] == pytest.approx(statistics.fmean(own))
        assert r["v"]["std_pop"] == pytest.approx(statistics.pstdev(own)) and (r["v"]["std_samp"] == pytest.approx(statistics.stdev(own)) if len(own) > 1 else r["v"]["std_samp"] is None)


def test_no_task_sorts_more_than_the_bound(spark):
    """Every round leaves the wanted cells only; what is sorted at last is within the bound."""
    n, bound = 50_000, 500
    df = spark.range(n).select(F.lit("all").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 3).alias("v"))
    counted = Q.count_values(df, {"v": "v"}, ["g"])
    seen = []
    real = Q._narrowed

    def watched(left, wanted, key, b):
        out = real(left, wanted, key, b)
        seen.append(out.groupBy(*key).count().agg(F.max("count")).first()[0])
        return out

    Q._narrowed = watched
    try:
        row = Q.quantiles(counted, [[0.1, 0.5, 0.9]], bound=bound).first()
    finally:
        Q._narrowed = real
    assert row["q0"] == pytest.approx([p * (n - 1) / 3 for p in (0.1, 0.5, 0.9)])
    assert 1 <= len(seen) <= 3 and seen[-1] <= bound


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.summaries(df, {"v": ("v", [0.5])}, ["g"]).collect() == []
    (row,) = Q.summaries(df, {"v": ("v", [0.5])}).collect()
    assert (row["rows"], row["v"]["n"], row["v"]["q"], row["v"]["max"]) == (0, 0, None, None)
