"""The growing cache against a dictionary; what an upsert and a compaction touch; writers that die."""

import os
import random

import pytest

from textcurate.sources.files import write_json
from textcurate.sources.keyed_cache import KeyedCache


def stamps(path):
    """Every data file with its time and size."""
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, os.stat(os.path.join(d, f)).st_size) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def bucket_of(file):
    return int(file.split("/bucket=")[1].split("/")[0])


def rows(spark, items):
    return spark.createDataFrame([(k, s, v) for (k, s), v in items], "post_id long, kind string, value string")


def test_upserts_like_a_dictionary(spark, tmp_path):
    rng, want = random.Random(4), {}
    cache = KeyedCache(spark, str(tmp_path / "c"), ["post_id", "kind"], buckets=8, most_runs=3)
    assert cache.load() is None
    for turn in range(7):
        new = {(rng.randrange(200), rng.choice("ab")): f"v{turn}" for _ in range(300 if turn == 0 else 25)}
        cache.upsert(rows(spark, new.items()))
        want |= new
        got = {(r["post_id"], r["kind"]): r["value"] for r in cache.load().collect()}
        assert got == want and cache.load().count() == len(want)
        assert max(len(x) for x in cache.live().values()) <= 3
    again = KeyedCache(spark, str(tmp_path / "c"), ["post_id", "kind"], buckets=99)
    assert again.buckets == 8 and {(r["post_id"], r["kind"]): r["value"] for r in again.load().collect()} == want
    again.compact()
    assert all(len(x) == 1 for x in again.live().values()) and again.load().count() == len(want)
    again.compact()
    assert again.load().count() == len(want)
    with pytest.raises(ValueError):
        KeyedCache(spark, str(tmp_path / "c"), ["post_id"])


def test_an_upsert_writes_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "c")
    cache = KeyedCache(spark, path, ["post_id"], buckets=32, most_runs=2)
    all_keys = spark.range(5000).selectExpr("id as post_id", "'old' as value")
    assert len(cache.upsert(all_keys)) == 32
    own = [r["post_id"] for r in all_keys.where(cache.bucket().isin(3, 17)).limit(50).collect()]  # a hundredth of the keys, in two buckets
    before = stamps(path)
    for turn in range(2):
        touched = cache.upsert(spark.createDataFrame([(k, f"new{turn}") for k in own], "post_id long, value string"))
        assert touched == [3, 17]
    after = stamps(path)
    assert all(after[f] == x for f, x in before.items() if bucket_of(f) not in (3, 17))  # the others are as they were
    assert {bucket_of(f) for f in after.keys() - before.keys()} == {3, 17}
    assert {b: len(x) for b, x in cache.live().items() if len(x) > 1 or b in (3, 17)} == {3: 1, 17: 1}  # compacted beyond two runs
    got = {r["post_id"]: r["value"] for r in cache.load().collect()}
    assert len(got) == 5000 and all(v == ("new1" if k in set(own) else "old") for k, v in got.items())
    looked = cache.load(spark.createDataFrame([(own[0],)], "post_id long"))
    assert all("/bucket=" in f and bucket_of(f) in (3, 17) for f in looked.inputFiles())
    todo = cache.pending(spark.createDataFrame([(own[0], "x"), (9000, "y")], "post_id long, text string"))
    assert [tuple(r) for r in todo.collect()] == [(9000, "y")]


def test_last_by_order_new_columns_and_dead_writers(spark, tmp_path):
    path = str(tmp_path / "c")
    cache = KeyedCache(spark, path, ["post_id"], buckets=4)
    cache.upsert(spark.createDataFrame([(1, "late", 2), (1, "early", 1), (2, "x", 1)], "post_id long, value string, at int"), order=["at"])
    cache.upsert(spark.createDataFrame([(2, "y", 5, True)], "post_id long, value string, at int, ok boolean"))
    assert {r["post_id"]: (r["value"], r["ok"]) for r in cache.load().collect()} == {1: ("late", None), 2: ("y", True)}
    # a run without a marker: its writer died
    spark.createDataFrame([(1, "lost", 9)], "post_id long, value string, at int").withColumn("bucket", cache.bucket()).write.partitionBy("bucket").parquet(f"{path}/data/run=2")
    assert {r["post_id"]: r["value"] for r in cache.load().collect()} == {1: "late", 2: "y"}
    assert cache.upsert(spark.createDataFrame([(3, "z", 1)], "post_id long, value string, at int")) != []
    assert {r["post_id"]: r["value"] for r in cache.load().collect()} == {1: "late", 2: "y", 3: "z"}
    assert cache.upsert(spark.createDataFrame([], "post_id long, value string, at int")) == []
    write_json(f"{path}/runs/none.json.part", {})  # a marker that was not renamed yet counts for nothing
    assert cache.load().count() == 3
