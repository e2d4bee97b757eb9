import json

import pytest
from pyspark.sql import functions as F

from textcurate.functions import overlap
from textcurate.functions import text as T
from textcurate.operators import cache as C
from textcurate.operators import evaluation as E
from textcurate.operators import generation as G
from textcurate.operators import nearest as N
from textcurate.operators import posts as P
from textcurate.operators import sampling as S
from textcurate.plans import pipelines, report
from textcurate.sources import files, readers, writers
from textcurate.streaming import incremental


def backend(model, system, prompt):
    text = prompt.split("<source_text>\n")[1].split("\n</source_text>")[0]
    if "bad" in text and model == G.PRIMARY:
        return {"content": "not json"}
    if "down" in text:
        raise G.Rejected
    content = {"neutral_text": "совсем иное " + " ".join(T_numbers(text)) + " a b"} if "Нейтрализуй" in prompt else {"topic": "тема", "facts": T_numbers(text), "entities": [], "numbers": []}
    return {"content": json.dumps(content), "prompt_tokens": 10, "completion_tokens": 5}


def T_numbers(text):
    import re

    return re.findall(r"\d+", text)


def posts(spark, n=20):
    return spark.createDataFrame([(i, f"2024-01-{i % 28 + 1:02d} 00:00:00", f"  Пост номер {i} про a и слова разные для длины текста пятьдесят. Второе! ", "chan") for i in range(n)], "post_id long, d string, text string, channel string").withColumn("date", F.to_timestamp("d")).drop("d")


def test_dedup_keeps_dated_and_first(spark):
    df = spark.createDataFrame([(1, None, "A  b"), (2, "2024-01-01", "a b"), (3, "2024-01-02", "a B"), (4, None, "c"), (4, None, "c")], "post_id long, d string, text string").withColumn("date", F.to_timestamp("d"))
    assert sorted(r["post_id"] for r in P.dedup_keep_earliest(df).collect()) == [2, 4]


@pytest.mark.parametrize("n, want", [(10, (8, 1, 1)), (9, (7, 1, 1)), (1, (0, 0, 1))])
def test_temporal_split(spark, n, want):
    df = spark.range(n).select(F.col("id").alias("post_id"), F.col("id").alias("date"))
    got = {r["split"]: r["count"] for r in P.temporal_split(df).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_overrides(spark):
    kinds = "post_id long, style_type string, neutral string, synthetic_input string, input string, failed boolean, synthetic_ok boolean, jaccard double, prompt_mode string"
    rows = [
        (11, "news", "plain report", None, None, False, None, 0.0, "short"),  # taken
        (12, " news ", None, "from the second column", None, None, True, 0.29, " "),  # taken, no mode
        (13, "news", "", "", "from the third", False, None, 0.1, "long"),  # taken
        (14, "news", "as close as the limit", None, None, False, None, 0.3, "short"),  # too much in common
        (15, "news", "no figure at all", None, None, False, None, None, "short"),  # nor one to compare
        (16, "jokes", "its call failed", None, None, True, False, 0.1, "short"),
        (17, "jokes", "neither flag is set", None, None, None, None, 0.1, "short"),
        (18, "jokes", "@only_a_handle", None, None, False, None, 0.1, "short"),  # nothing is left of it
        (None, "jokes", "no post", None, None, False, None, 0.1, "short"), (19, " ", "no style", None, None, False, None, 0.1, "short"),
        (11, "news", "said again", None, None, False, None, 0.2, "long"),  # the later one counts
    ]
    c = P.classify_overrides(spark.createDataFrame(rows, kinds), 0.3).withColumn("pos", F.monotonically_increasing_id())
    told = {k: sum(r["status"] == k for r in c.collect()) for k in ("accepted", "rejected_failed", "rejected_missing_input", "rejected_jaccard", "skipped")}
    assert told == {"accepted": 4, "rejected_failed": 2, "rejected_missing_input": 1, "rejected_jaccard": 2, "skipped": 2}
    assert P.override_stats(c).first().asDict() == {"loaded": len(rows), **{k: n for k, n in told.items() if k != "skipped"}}
    taken = {r["post_id"]: (r["override_input"], r["override_source"]) for r in P.accepted_overrides(c, "pos").collect()}
    assert taken == {11: ("said again", "llm_long"), 12: ("from the second column", "llm_synthetic"), 13: ("from the third", "llm_long")}
    assert P.classify_overrides(spark.createDataFrame(rows, kinds)).where("status = 'rejected_jaccard'").count() == 0


def test_prepare(spark):
    r = pipelines.prepare(posts(spark), "type1").cache()
    assert r.count() == 20 and {x["split"] for x in r.select("split").collect()} == {"train", "val", "test"}
    assert r.where("prompt like '%### Response:%' and input like 'Topic: %'").count() == 20


def test_sampling(spark):
    base = spark.createDataFrame(
        [(i, ["news", "jokes", "ads"][i % 3], f"post no {i}" if i % 5 else "post", 40 + 7 * i % 90, 1 + i % 4 // 2, i % 7 == 0, "val" if i % 11 else "train", f"2024-02-{i % 28 + 1:02d}") for i in range(150)],
        "post_id long, style_type string, response_clean string, char_len int, n_paragraphs int, has_emoji boolean, split string, date string",
    )
    m = S.pilot_manifest(base, 9)
    rows = m.collect()
    assert {t: sum(r["style_type"] == t for r in rows) for t in ("news", "jokes", "ads")} == {"news": 9, "jokes": 9, "ads": 9} and len(m.columns) == 18
    assert all(r["pilot_id"] == f"{r['style_type']}:{r['post_id']}" and r["post_id"] % 11 for r in rows)
    assert sorted(map(str, S.pilot_manifest(base.repartition(5), 9).drop("manifest_created_at").collect())) == sorted(map(str, m.drop("manifest_created_at").collect()))
    ties = spark.createDataFrame([(i, x, 1, False, "a") for i, x in enumerate([1, 1, 1, 1, 2])], "post_id long, char_len int, n_paragraphs int, has_emoji boolean, response_clean string")
    assert all(r["char_len_q"] for r in S.add_strata(ties).collect())
    assert S.stratified_sample(S.add_strata(base), 25).count() == 25


def test_quality(spark):
    rows = [
        ("call 112 now", False, 0.5, False, True, 1.2), ("call 112 now", False, 0.1, False, False, 0.39), ("no digits", False, 0.29, True, False, 1.0), ("no digits", False, 0.3, False, True, 0.4),
        ("call 112 now", True, 0.9, True, True, 9.0), (None, False, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "response_clean string, f boolean, jaccard double, is_identity boolean, numbers_preserved boolean, length_ratio double")
    s = E.summarize_quality(df, "f").first().asDict()
    assert (s["n_total"], s["n_active"], s["failed_rate"]) == (6, 5, round(1 / 6, 4))
    assert (s["jaccard_ge_0_5"], s["identity_rate"], s["length_collapse_rate"], s["good_neutral_rate"]) == (0.2, 0.2, 0.2, 0.2)
    assert s["number_preservation"] == 0.5 and s["mean_length_ratio"] == round((1.2 + 0.39 + 1.0 + 0.4) / 4, 4)  # of texts that have digits
    none = E.summarize_quality(df.where("f"), "f").first().asDict()
    assert none["n_active"] == 0 and none["identity_rate"] is None
    kinds = "jaccard_ge_0_5 double, identity_rate double, number_preservation double, length_collapse_rate double, good_neutral_rate double"
    limits = (0.05, 0.02, 0.95, 0.10, 0.70)  # at its limit a metric passes
    for k, miss in [(None, None), (0, 0.051), (1, 0.021), (2, 0.949), (3, 0.101), (4, 0.699), (2, None)]:
        given = [miss if i == k else x for i, x in enumerate(limits)]
        g = E.quality_gate(spark.createDataFrame([tuple(given)], kinds)).first()
        assert g["quality_gate_passed"] == (k is None)
        if k is not None:
            assert not g[list(E.QUALITY_TARGETS)[k] + "_pass"]


def test_generation_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "число 12 x y z", "2024-01-01"), (2, "bad 7 слова тут", "2024-01-02"), (3, "down 5", "2024-01-03")], "post_id long, response_clean string, date string")
    out = {r["post_id"]: r for r in G.neutralize(df, backend).collect()}
    assert out[1]["synthetic_ok"] is False or out[1]["failure_reason"] is None
    assert out[2]["usage"]["used_fallback"] and len(out[2]["attempts"]) == 2 and out[3]["failure_reason"].startswith("provider_rejected")
    path = str(tmp_path / "cache")
    a = G.run_resumable(df, path, backend, ["post_id"], chunk=2)
    assert a.count() == 3
    assert G.run_resumable(df, path, backend, ["post_id"], chunk=2).count() == 3 and spark.read.parquet(path).count() == 3
    assert G.two_pass_brief(df.where("post_id = 1"), backend).first()["used_two_pass"]


def test_cache_operators(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, C.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["k"] for r in C.pending(new, old, ["k"]).collect()] == [3]
    rows = spark.range(10).withColumn("ok", F.col("id") % 2 == 0)
    assert C.until_target(rows, F.col("ok"), [F.col("id")], 2, 2).count() == 4


def test_sources_and_sinks(spark, tmp_path):
    d = tmp_path / "chan"
    d.mkdir()
    (d / "result.json").write_text(json.dumps({"messages": [{"id": 1, "type": "message", "date": "2024-01-01T10:00:00", "text": ["a ", {"type": "bold", "text": "B"}, {"type": "x"}, " c"]}, {"id": 2, "type": "message", "text": "[plain]", "date": "bad"}, {"id": 3, "type": "service"}, {"id": 4, "type": "message"}]}))
    rows = {r["post_id"]: r for r in readers.read_export(spark, str(d / "result.json")).collect()}
    assert rows[1]["text"] == "a B c" and rows[2]["text"] == "[plain]" and rows[2]["date"] is None and rows[4]["text"] == "" and rows[1]["channel"] == "chan" and len(rows) == 3
    (tmp_path / "g.txt").write_text("x\n===\ny\n\n===\n\n===\nz\n")
    assert [r["text"] for r in readers.read_blocks(spark, str(tmp_path / "g.txt")).orderBy("pos").collect()] == ["x", "y", "z"]
    assert readers.read_blocks(spark, str(tmp_path / "none.txt")) is None
    (tmp_path / "l.txt").write_text("a\n\n b \n")
    assert [r["text"] for r in readers.read_lines(spark, str(tmp_path / "l.txt")).orderBy("pos").collect()] == ["a", " b "]
    rec = spark.createDataFrame([(1, "t1", "val", None), (2, "t1", "train", "ю")], "post_id long, style_type string, split string, v string")
    writers.write_splits(rec, str(tmp_path / "s"))
    assert readers.read_split(spark, str(tmp_path / "s"), "t1", "val").first()["post_id"] == 1 and readers.read_split(spark, str(tmp_path / "s"), "t9", "val") is None
    writers.write_jsonl(rec, str(tmp_path / "a")), writers.write_jsonl(rec.withColumn("v", F.lit("new")).limit(1), str(tmp_path / "b"))
    got = readers.read_caches(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "zz")], ["style_type", "post_id"])
    assert sorted((r["post_id"], r["v"]) for r in got.collect()) == [(1, "new"), (2, "ю")]
    writers.write_blocks(spark.createDataFrame([(1, "b"), (0, "a")], "pos int, generated string"), str(tmp_path / "out"), {"n": 2})
    assert [r["text"] for r in readers.read_blocks(spark, str(tmp_path / "out")).orderBy("pos").collect()] == ["a", "b"]
    writers.write_csv(rec, str(tmp_path / "c"))
    assert readers.read_optional(spark, str(tmp_path / "c"), "csv").count() == 2 and readers.read_optional(spark, str(tmp_path / "no")) is None
    p = str(tmp_path / "r.json")
    writers.merge_report(p, {"x": 1}, {"t1": {"n": 1}})
    assert set(writers.merge_report(p, {"x": 2}, {"t2": {"n": 2}})) == {"_meta", "t1", "t2"}


def test_evaluation(spark):
    texts = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("кошка мяу " * 5, "type1"), ("собака гав " * 5, "type2")] * 6)], "pos int, response_clean string, style_type string").withColumn("input", F.lit("x"))
    model = E.StyleClassifier(["type1", "type2"], 500).fit(texts, "response_clean", "style_type")
    out = pipelines.evaluate(texts, texts.select("pos", F.col("response_clean").alias("text")), model)
    assert out["style"]["style_accuracy"] == 1.0 and out["cosine"]["mean"] == pytest.approx(1.0) and out["mauve"]["mauve"] > 0.9
    near = N.nearest_texts(texts.limit(2), texts, "pos", "response_clean", "pos", "response_clean").collect()
    assert all(r["fuzz_ratio"] == 100.0 and r["jaccard_5gram"] == 1.0 for r in near) and not E.memorisation_summary(spark.createDataFrame(near)).first()["passed"]
    assert "no data" in report.build({"a": [{"x": 1.0}], "b": None}) and report.duration(3700) == "1h 1m 40s" and report.delta(1.0, None) == report.DASH


def test_streaming(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string").write.parquet(str(src))
    stream = lambda: spark.readStream.schema("k long, v string").parquet(str(src))
    for _ in range(2):
        incremental.upsert_stream(stream(), str(tmp_path / "cache"), str(tmp_path / "ck"), ["k"]).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    assert incremental.dedup_stream(spark.readStream.format("rate").load().select(F.col("timestamp").alias("date"), F.lit("x").alias("text"))).isStreaming


def test_ranks_match_a_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("o"))
    from pyspark.sql import Window

    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("o"))).select("g", "o", "rank")
    assert sorted(map(tuple, P.ranks(df, ["g"], ["o"]).select("g", "o", "rank").collect())) == sorted(map(tuple, want.collect()))
    assert T.CTA_PATTERNS


def test_sources_of_validation_rows(spark):
    df = spark.createDataFrame([(1, "llm_brief_v4", True), (2, "heuristic", False)], "post_id long, input_source string, synthetic_ok boolean")
    assert [r["post_id"] for r in P.filter_by_source(df, "heuristic").collect()] == [2] and P.filter_by_source(df, "").count() == P.filter_by_source(df, None).count() == 2
    assert P.validation_rows(df, "heuristic").count() == 1 and P.validation_rows(df, "other", "all").count() == 2
    with pytest.raises(ValueError, match="no validation records"):
        P.validation_rows(df, "other")
    with pytest.raises(ValueError, match="fallback"):
        P.validation_rows(df, "other", "some")
    assert [r["post_id"] for r in P.usable(df).collect()] == [1]


def test_several_values(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "z"), (None, "q")], "style_type string, text string")
    assert not P.has_several(df, "style_type") and P.has_several(df, "text")
    assert [r["style_type"] for r in E.length_report(df).collect()] == ["all"]
    assert {r["style_type"] for r in E.length_report(df.withColumn("style_type", F.col("text"))).collect()} == {"x y", "z", "q"}


def test_files_and_config(spark, tmp_path):
    p = str(tmp_path / "deep" / "x.json")
    assert files.read_json(p) is None and not files.exists(p) and files.load_config(str(tmp_path / "none.yaml")) == {}
    files.write_json(p, {"a": {"b": [1, "ю"]}})
    files.write_json(p, {"a": {"b": [2]}})
    assert files.read_json(p) == {"a": {"b": [2]}} and files.exists(p)
    files.write_text(str(tmp_path / "c.yaml"), "max_samples:\n  type1: 5\n")
    config = files.load_config(str(tmp_path / "c.yaml"))
    assert files.dig(config, "max_samples", "type1") == 5 and files.dig(config, "max_samples", "type1", "x") is None and files.dig(None, "a") is None
    files.write_text(str(tmp_path / "e.yaml"), "\n")
    assert files.load_config(str(tmp_path / "e.yaml")) == {}
    limit = lambda t, given=None: pipelines.resolve_limit(given, config["max_samples"], 100, t)
    assert (limit("type1"), limit("type2"), limit("type1", 7)) == (5, 100, 7)
    with pytest.raises(ValueError):
        limit("type1", 0)


def test_manifest_is_built_once(spark, tmp_path):
    rows = [(i, "type1", f"Запись {i} и число {i}", 90 + i, 1, False, "val", "2024-02-01") for i in range(12)]
    df = spark.createDataFrame(rows, "post_id long, style_type string, response_clean string, char_len int, n_paragraphs int, has_emoji boolean, split string, date string")
    path = str(tmp_path / "manifest")
    one = sorted(r["pilot_id"] for r in pipelines.load_or_build_manifest(spark, path, df, 3).collect())
    two = sorted(r["pilot_id"] for r in pipelines.load_or_build_manifest(spark, path, df.limit(0), 9).collect())
    assert one == two and len(one) == 3
    assert pipelines.load_or_build_manifest(spark, str(tmp_path / "no"), df.limit(0), 3).isEmpty() and readers.read_optional_lines(spark, str(tmp_path / "no")) is None
    assert list(readers.read_present(spark, [path, str(tmp_path / "no")])) == [path]


def test_reports(spark, tmp_path):
    at = str(tmp_path)
    one = spark.createDataFrame([(1, 0.5)], "n int, rate double")
    assert writers.write_generation_report(f"{at}/g.json", {"model": "m"}, {"f1": one}) == files.read_json(f"{at}/g.json") == {"meta": {"model": "m"}, "files": [{"path": "f1", "n": 1, "rate": 0.5}]}
    out = {"type1": {"style": {"style_accuracy": 0.5, "style_confidence": 0.4}, "cosine": {"mean": 0.9}, "mauve": {"mauve": 0.2}, "confusion": [{"style_type": "type1", "n": 2, "to_type1": 0.5, "to_type2": 0.5}]}}
    writers.write_evaluation(f"{at}/base", out, {"type1": one}, {"type1": one})
    better = {"type1": {**out["type1"], "style": {"style_accuracy": 0.9, "style_confidence": 0.8}, "mauve": {"mauve": 0.8}}}
    writers.write_evaluation(f"{at}/tuned", better)
    assert readers.read_optional(spark, f"{at}/base/length_type1.csv", "csv").count() == 1 and files.read_json(f"{at}/tuned/cross_type_confusion.json")
    files.write_json(f"{at}/split.json", {"type1": {"train": 8, "val": 1, "test": 1}, "_meta": {"min_chars": 50}})
    files.write_json(f"{at}/run.json", {"base_model": "b", "hyperparams": {"lora_r": 16}, "metrics": {"train_loss": 1.5}, "duration_seconds": 61})
    memory = {"type1": {"fuzz_median": 30.0, "fuzz_max": 99.0, "run_max": 40}}
    near = {"type1": [{"generated": "a|b", "nearest_id": 3, "fuzz_ratio": 50.0, "jaccard_5gram": 0.1, "longest_common_chars": 40}]}
    text = report.results_from(["type1"], f"{at}/split.json", f"{at}/base", f"{at}/tuned", {"type1": [f"{at}/none.json", f"{at}/run.json"]}, memorisation=memory, nearest=near, notes=["small"])
    for part in ("| train | 8 |", "lora_r | 16", "1m 1s", "+0.400", "type1: better", "Mean diagonal 50.0%, by chance 50.0%", "longest run: 40.0 (below 30: no)", "**FAIL**", "a\\|b", "- small"):
        assert part in text, part
    assert report.results(["type1"]).count("no data yet") == 6
    assert writers.tsv(one.withColumn("path", F.lit("p")), writers.COST_COLUMNS).splitlines()[1].startswith("p\t")


def test_cost_table(spark):
    df = spark.createDataFrame([("a", "один два"), ("a", "x"), ("b", "три")], "path string, response_clean string")
    rows = {r["path"]: r for r in pipelines.cost_table(df, "openai/gpt-4.1-mini").collect()}
    assert set(rows) == {"a", "b", "TOTAL"} and rows["TOTAL"]["n_records"] == 3 and rows["TOTAL"]["usage_total_tokens"] == rows["a"]["usage_total_tokens"] + rows["b"]["usage_total_tokens"]
    assert [r["path"] for r in pipelines.cost_table(df.where("path = 'a'"), "openai/gpt-4.1-mini").collect()] == ["a"]


def test_calls_run_at_once(spark):
    import time

    def slow(model, system, prompt):
        time.sleep(0.3)
        return {"content": json.dumps({"neutral_text": prompt.split("<source_text>\n")[1].split("\n")[0]})}

    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i long, response_clean string").coalesce(1)
    G.attempts(df.limit(1), "response_clean", slow).collect()
    began = time.time()
    rows = G.attempts(df, "response_clean", slow, concurrency=10).collect()
    assert time.time() - began < 4 and all(json.loads(r["attempts"][0]["content"])["neutral_text"] == r["response_clean"] for r in rows)
    with pytest.raises(ValueError):
        G.attempts(df, "response_clean", slow, concurrency=0)


def test_frontier_of_histograms():
    import numpy as np

    g = np.random.default_rng(3)
    a, b = g.random(12), g.random(12)
    a[:2], b[2:4] = 0, 0
    a, b = a / a.sum(), b / b.sum()
    w = (np.arange(20_000) + 0.5) / 20_000
    kl = lambda x, m: np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / m), 0).sum(-1)
    mix = w[:, None] * a + (1 - w[:, None]) * b
    want = 2 * (w * kl(a, mix) + (1 - w) * kl(b, mix)).mean()
    assert E.frontier_integral(a, b) == pytest.approx(want, abs=1e-5) and E.frontier_integral(a, a) == 0
    assert E.frontier_area(a, a) == pytest.approx(1.0, abs=1e-6) and E.frontier_area(np.array([1.0, 0]), np.array([0, 1.0])) < 0.02 < E.frontier_area(a, b) < 1


def test_failed_rows_keep_no_flag(spark):
    df = spark.createDataFrame([("три 3 слова", "", True), ("три 3 слова", "иное 3", False)], "o string, c string, f boolean")
    failed, good = [r["s"] for r in df.select(overlap.score(F.col("o"), F.col("c"), F.col("f")).alias("s")).collect()]
    assert (failed["is_identity"], failed["numbers_preserved"], failed["jaccard"], failed["length_ratio"]) == (False, False, None, None)
    assert failed["quality_flags"].asDict() == {"numbers_ok": False, "identity": False, "jaccard_bin": None, "length_collapse": None}
    assert good["numbers_preserved"] and not good["is_identity"] and good["quality_flags"]["numbers_ok"]


def test_ngram_overlap_by_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 14))), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for _ in range(150)] + [("a " * 4000, "a " * 4000 + "b")]
    grams = lambda t, n: [tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", overlap.longest_common_ngram(F.col("a"), F.col("b")).alias("n"), overlap.copied_ngram_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        have, own = set(grams(r["a"], 4)), grams(r["b"], 4)
        assert r["n"] == max((n for n in range(1, 9) if set(grams(r["a"], n)) & set(grams(r["b"], n))), default=0)
        assert r["r"] == pytest.approx(sum(g in have for g in own) / len(own) if have and own else 0.0)


def test_nearest_texts_by_brute_force(spark):
    import random
    import statistics

    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(n))
    corpus = [(i, text(rng.randint(0, 14))) for i in range(40)] + [(50, None), (51, "")]
    asked = [(100 + i, t) for i, (_, t) in enumerate(corpus[:4])] + [(200 + i, text(8)) for i in range(6)] + [(300, ""), (301, None)]
    norm = lambda t: " ".join((t or "").lower().split())

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    def five(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {(x,) for x in w}

    want = {}
    for i, t in asked:
        t = norm(t)
        near, c, u = min(((-ratio(t, norm(u)), c, norm(u)) for c, u in corpus), key=lambda x: x[:2])
        both, all_ = five(t) & five(u), five(t) | five(u)
        run = max((n - m for m in range(len(t)) for n in range(m + 1, len(t) + 1) if t[m:n] in u), default=0)
        want[i] = (c, pytest.approx(-near, abs=1e-4), pytest.approx(len(both) / len(all_) if all_ else 1.0, abs=1e-4), run)
    q, c = spark.createDataFrame(asked, "item_id long, text string"), spark.createDataFrame(corpus, "doc_id long, text string")
    found = N.nearest_texts(q, c, "item_id", "text", "doc_id", "text").cache()
    got = {r["query_id"]: (r["nearest_id"], r["fuzz_ratio"], r["jaccard_5gram"], r["longest_common_chars"]) for r in found.collect()}
    assert got == want
    again = N.nearest_texts(q, c, "item_id", "text", "doc_id", "text", group_bytes=300)  # many groups and several blocks of queries
    assert {r["query_id"]: (r["nearest_id"], r["fuzz_ratio"], r["jaccard_5gram"], r["longest_common_chars"]) for r in again.collect()} == want
    assert N.nearest_texts(q, c.where("false"), "item_id", "text", "doc_id", "text").collect() == []
    assert N.nearest_texts(q.where("false"), c, "item_id", "text", "doc_id", "text").collect() == []
    s, fuzz = E.memorisation_summary(found).first(), [v[1] for v in got.values()]
    assert (s["n"], s["n_exact"], s["fuzz_max"], s["passed"]) == (len(asked), sum(x == 100 for x in fuzz), max(fuzz), False)
    assert s["fuzz_median"] == pytest.approx(statistics.median(fuzz)) and s["n_long"] == sum(v[3] >= E.MEMORISATION["run_below"] for v in got.values())


def test_search_takes_equal_texts_and_queries_once(monkeypatch):
    import pyarrow as pa

    made, run = [], N.fuzzy.subsequence
    monkeypatch.setattr(N.fuzzy, "subsequence", lambda *a: made.append(a) or run(*a))
    names = ["hot bolt", "old ring", "blue plate"]
    texts = pa.table({"id": list(range(900)), "t": [names[(i + 1) % 3] for i in range(900)]})
    # digits and # are in no text; the last two queries have other lengths and an own bound that nothing reaches
    asked = [(i, f"supplier#{i:03}", -1.0) for i in range(200)] + [(200, "supplier#1", -1.0), (201, "supplier#0", 99.0), (202, "###", -1.0), (203, "012", -1.0), (204, "old ring", 50.0)]
    found = N.search(texts, pa.table({"q": [x[0] for x in asked], "qt": [x[1] for x in asked], "least": [x[2] for x in asked]})).to_pylist()
    searched, want = len(made), []
    for q, t, least in asked:
        fuzz, i = min((-N.fuzzy.indel_ratio(t, texts["t"][k].as_py()), k) for k in range(900))
        if -fuzz >= least:
            want.append({"q": q, "qt": t, "fuzz": -fuzz, "id": i, "t": names[(i + 1) % 3]})
    assert sorted(found, key=lambda r: r["q"]) == want and {r["q"] for r in found} == {*range(205)} - {201}
    assert searched <= 5 * 3  # five classes of queries, three texts


def test_nearest_texts_merges_sides_of_copies(spark, monkeypatch):
    sent, bounds = [], N._first_bounds
    monkeypatch.setattr(N, "_first_bounds", lambda asked, texts, *a: sent.append((asked.count(), texts.count())) or bounds(asked, texts, *a))
    names = ["hot bolt", "old  ring", "blue plate", ""]
    rows = lambda n, pick: spark.createDataFrame([(i, pick(i)) for i in range(n)], "id long, text string")
    few, many = [f"Supplier {i}" for i in range(5)] + ["OLD ring", None], rows(400, lambda i: names[i * 7 % 4])
    for q, c, want in ((rows(210, lambda i: few[i % 7]), many, (7, 4)), (rows(7, lambda i: few[i]), many, (7, 4)), (rows(210, lambda i: few[i % 7]), rows(4, lambda i: names[i]), (7, 4))):
        found = sorted(tuple(r) for r in N.nearest_texts(q, c, "id", "text", "id", "text").collect())
        texts = {i: " ".join((t or "").lower().split()) for i, t in c.collect()}
        least = []
        for i, t in sorted(q.collect()):
            t = " ".join((t or "").lower().split())
            fuzz, k = min((-N.fuzzy.indel_ratio(t, x), k) for k, x in texts.items())
            ours, other = set(t.split()), set(texts[k].split())
            least.append((i, k, round(-fuzz, 4), round(len(ours & other) / max(len(ours | other), 1), 4), N.fuzzy.common_substring(t, texts[k])))
        assert [(*r[:3], r[4]) for r in found] == [(*r[:3], r[4]) for r in least]
        assert [r[3] for r in found if texts[r[1]]] == [r[3] for r in least if texts[r[1]]]
        assert sent.pop() == want


@pytest.mark.parametrize("hot, listed", [(0, 20_000), (2, 20_000), (8, 10), (1000, 10)])
def test_nearest_by_shingles_by_brute_force(spark, monkeypatch, hot, listed):
    """Texts that all share a 5-gram, 5-grams of many texts, ties of the rounded ratio, short and empty texts."""
    import random

    monkeypatch.setattr(N, "LISTED", listed)
    rng = random.Random(8)
    phrases = [" ".join(rng.choice(["w", "x", "y", "z"]) + str(rng.randrange(30)) for _ in range(6)) for _ in range(12)]
    corpus = [(i, "in every text one shingle " + " . ".join(rng.choices(phrases[:2] * 4 + phrases, k=rng.randrange(5))) + " pad" * rng.randrange(3)) for i in range(60)]
    corpus += [(100, "short text"), (101, None), (102, ""), (103, "other words stand here alone now"), (None, corpus[0][1])]
    asked = [(i, " . ".join(["in every text one shingle"] * (i % 2) + rng.sample(phrases, rng.randrange(1, 4)))) for i in range(12)]
    asked += [(20, corpus[7][1]), (21, "in every text one shingle"), (22, "short"), (23, "nothing of this is there at all"), (24, None)]

    def five(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {(x,) for x in w}

    want = {}
    for q, t in asked:
        both = [(-round(len(five(t) & five(u)) / len(five(t) | five(u)), 6), c, len(five(t) & five(u))) for c, u in corpus if c is not None and five(t) & five(u)]
        if both:
            j, c, n = min(both)
            want[q] = (c, -j, n)
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    found = N.nearest_by_shingles(df(asked, "item_id"), df(corpus, "doc_id"), "item_id", "text", "doc_id", "text", hot=hot)
    assert {r["query_id"]: (r["nearest_id"], r["jaccard_5gram"], r["n_shared"]) for r in found.collect()} == want
    assert len(want) == 15


def test_classifier_weights_by_definition(spark):
    import math
    from collections import Counter

    texts = ["кот идет", "кот кот", "a", "собака идет домой", ""]
    df = spark.createDataFrame([(i, t, "x" if i % 2 else "y") for i, t in enumerate(texts)], "i int, t string, label string")
    model = E.StyleClassifier(["x", "y"]).fit(df, "t", "label")

    def grams(t):
        out = Counter()
        for w in t.lower().split():
            p = f" {w} "
            for n in (2, 3, 4):
                if len(p) <= n:
                    out[p] += 1
                    break
                out.update(p[k : k + n] for k in range(len(p) - n + 1))
        return out

    own = [grams(t) for t in texts]
    df_of = Counter(g for o in own for g in o)
    names = sorted(df_of)
    for r in model._vectors(df, "t").collect():
        raw = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df_of[g])) + 1) for g, n in own[r["i"]].items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        got = {names[k]: v for k, v in zip(r["features"].indices.tolist(), r["features"].values.tolist())}
        assert got == {g: pytest.approx(x / norm) for g, x in raw.items()}
    assert E.StyleClassifier(["x", "y"], 3).fit(df, "t", "label")._weights.keys() == set(sorted(df_of, key=lambda g: (-sum(o[g] for o in own), g))[:3])
