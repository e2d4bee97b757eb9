"""Lines and blocks read in splits and written in ranges, in order; summaries of datasets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textcurate.operators import posts as P
from textcurate.plans import pipelines
from textcurate.sources import readers, writers


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}

    def use(size):
        for k, v in zip(names, (size, 1)):
            spark.conf.set(k, str(v))

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def told(df):
    rows = df.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [r["text"] for r in rows]


@pytest.mark.parametrize("size", [40, 300, 1 << 27])
def test_lines_and_blocks_in_order(spark, tmp_path, splits, size):
    rng = random.Random(size)
    texts = [rng.choice(["", " ", "é = ===", "==\n==", "a\n\nb", "x " * rng.randrange(40), "===" * 3]) + str(i) * rng.randrange(2) for i in range(300)]
    (tmp_path / "blocks").mkdir()
    for k in range(3):
        (tmp_path / "blocks" / f"{k}.txt").write_text("\n===\n".join(texts[100 * k : 100 * k + 100]))
    lines = [rng.choice(["", "  ", "line é ", " b"]) + str(i) * rng.randrange(2) for i in range(400)]
    (tmp_path / "lines.txt").write_text("\r\n".join(lines))
    splits(size)
    assert told(readers.read_blocks(spark, str(tmp_path / "blocks"))) == [t.strip() for t in texts if t.strip()]
    assert told(readers.read_lines(spark, str(tmp_path / "lines.txt"))) == [x for x in lines if x.strip(" ")]
    if size < 1000:
        assert spark.read.text(str(tmp_path / "lines.txt")).rdd.getNumPartitions() > 8


def test_blocks_written_by_many_tasks(spark, tmp_path, splits):
    n = 30_000
    df = spark.range(n).select((n - 1 - F.col("id")).alias("pos"), F.concat(F.lit("block "), n - 1 - F.col("id"), F.lit("\nof two lines")).alias("generated")).repartition(6)
    writers.write_blocks(df, str(tmp_path / "out"), {"n": n}, parts=12)
    files = sorted(f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-"))
    assert len(files) >= 9 and max(f.stat().st_size for f in files) < sum(f.stat().st_size for f in files) / 4
    assert "".join(f.read_text() for f in files) == "".join(f"block {i}\nof two lines\n===\n" for i in range(n))
    splits(20_000)
    back = readers.read_blocks(spark, str(tmp_path / "out"))
    assert back.where(F.col("text") != F.concat(F.lit("block "), "pos", F.lit("\nof two lines"))).count() == 0 and back.count() == n
    writers.write_blocks(spark.createDataFrame([(0, None)], "pos int, generated string"), str(tmp_path / "none"))
    assert readers.read_blocks(spark, str(tmp_path / "none")) is None


def test_enriched_records_name_their_settings(spark):
    df = spark.createDataFrame([(1, "Visit 3 shops", "x", "heuristic"), (2, "Visit 3 shops", "y", "heuristic")], "post_id long, response_clean string, input string, input_source string")
    df = df.withColumn("candidate", F.when(F.col("post_id") == 1, "go to 3 shops").otherwise("go to shops"))
    out = P.enrich(df, "candidate", "openrouter", "m", F.lit("now"), config={"max_tokens": 100, "temperature": 0.3}, extra={"prompt_mode": F.lit("rewrite"), "input": F.upper("input")})
    rows = {r["post_id"]: r for r in out.collect()}
    assert rows[1]["synthetic_config"].asDict() == {"max_tokens": 100, "temperature": 0.3} and rows[1]["prompt_mode"] == "rewrite"
    assert (rows[1]["input"], rows[2]["input"], rows[2]["failure_reason"]) == ("GO TO 3 SHOPS", "", "numbers_not_preserved")
    assert P.enrich(df, "candidate", "openrouter", "m", F.lit("now")).first()["synthetic_config"] is None


def test_summaries_of_datasets(spark, tmp_path):
    rows = [
        ("a.jsonl", "type1", "val", "call 5 people", False, 0.2, False, True, 0.9, 100, 50, 0.01), ("a.jsonl", "type1", "val", "plain", True, None, None, None, None, 0, 0, None),
        ("b.jsonl", "type2", "val", "other words", False, 0.6, False, True, 0.3, 10, 5, 0.002),
    ]
    kinds = "path string, style_type string, split string, response_clean string, synthetic_failed boolean, jaccard double, is_identity boolean, numbers_preserved boolean, length_ratio double, usage_prompt_tokens long, usage_completion_tokens long, cost_usd_estimate double"
    out = pipelines.dataset_summaries(spark.createDataFrame(rows, kinds))
    table = writers.write_summaries(str(tmp_path / "s.json"), out)
    told = json.loads((tmp_path / "s.json").read_text())
    assert [(x["path"], x["n_total"], x["failed_rate"], x["jaccard_ge_0_5"], x["usage_total_tokens"], x["cost_usd_estimate"]) for x in told] == [("a.jsonl", 2, 0.5, 0.0, 150, 0.01), ("b.jsonl", 1, 0.0, 1.0, 15, 0.002)]
    assert [x["quality_gate_passed"] for x in told] == [True, False]
    head, *lines = table.split("\n")
    assert head.split("\t") == out.columns and len(lines) == 2 and lines[0].startswith("type1\tval\ta.jsonl")
