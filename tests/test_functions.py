import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textcurate.functions import cost, fuzzy, overlap, payload, prompts
from textcurate.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, text, want",
    [
        (T.strip, "  a b \n", "a b"), (T.normalize, "  A  b\n\nC ", "a b c"), (T.clean, "строка\nПОДПИСКА тут\nконец", "строка\n\nконец"), (T.clean, "a😀b☀c🌀", "abc"),
        (T.clean, "@handle1 x https://t.me/q y http://z #тег_1", "x y"), (T.sentences, "Одно. Два!  Три? да 3.5 конец.", ["Одно.", "Два!", "Три?", "да 3.5 конец."]),
        (T.tokens, "Привет, мир_2 ½ x²", ["привет", "мир_2", "½", "x²"]), (T.numbers, "1 и 2,5 и 1", ["1", "2,5"]), (T.paragraphs, " a \n\n\n\nb", ["a", "b"]), (T.paragraphs, " ", [""]),
        (T.strip_cta, "a\nЖМИ  сюда\nb", "a\nb"), (T.heuristic_brief, "A. B! C?", "Topic: A.\nFacts:\n- B!\n- C?"), (T.heuristic_brief, "", ""), (T.shingles5, "a b", ["a", "b"]),
        (payload.strip_fences, '```json\n{"a":1}\n```', '{"a":1}'), (prompts.extract_response, "p ### Response: a ### Response: b</s>", "b"), (prompts.extract_response, "abc</s>", "abc</s>"),
    ],
)
def test_text_functions(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_prompts(spark):
    assert "не более 4" in one(spark, prompts.user_prompt(F.col("t"), "brief_v2", 4), t="x")
    assert "entities <= 4" in one(spark, prompts.user_prompt(F.col("t"), "brief_v3", 4), t="x")
    assert one(spark, prompts.user_prompt(F.col("t"), "brief_v4", 4), t="{text}").count("{text}") == 1
    assert one(spark, prompts.training_prompt(F.lit("type1"), F.col("t"), F.lit("R")), t="I").endswith("### Input:\nI\n\n### Response:\nR")
    assert prompts.response_format("brief_v3")["json_schema"]["strict"]
    with pytest.raises(ValueError, match="Unknown prompt mode"):
        prompts.check_mode("nope")


@pytest.mark.parametrize(
    "source, candidate, limits, reason, jaccard",
    [
        ("Рынок открыт в 9", "Рынок открыт в 9", {}, "identity", 1.0),
        ("Мост закрыт до 7 мая", "Мост закрыт до 7 мая, объезд", {}, "high_overlap", round(5 / 6, 4)),
        ("река дом лес гора поле сад", "река дом лес гора поле двор и сарай", {"max_jaccard": 0.99, "max_shared_ngram": 5}, "copied_span", round(5 / 9, 4)),
        ("река дом лес гора поле сад", "река дом лес гора поле двор и сарай", {"max_jaccard": 0.99, "max_copy_ratio": 0.25}, "copied_4gram_ratio", round(5 / 9, 4)),
        ("снег дождь", "ветер туман", {}, "high_overlap", 0.0), ("всего 40 мест", "мест много", {}, "numbers_not_preserved", 0.25), ("b", " @nobody_1 ", {}, "empty_after_clean", None),
        ("p q r s", "p t u v w x y", {}, None, 0.1),
    ],
)
def test_validation(spark, source, candidate, limits, reason, jaccard):
    df = spark.createDataFrame([(source, candidate)], "o string, c string")
    v = overlap.with_validation(df, "o", "c", **limits).select("validation.*").first()
    assert v["failure_reason"] == reason and v["failed"] == (reason is not None)
    if jaccard is not None:
        assert round(one(spark, overlap.jaccard(F.col("a"), F.col("b")), a=source, b=candidate), 4) == jaccard
    if reason is None:
        assert v["jaccard"] == jaccard and v["quality_flags"]["jaccard_bin"] == "<0.2"
    else:
        assert v["quality_flags"]["numbers_ok"] is False and v["is_identity"] is False


def test_short_texts_have_no_ngrams(spark):
    assert one(spark, overlap.copied_ngram_ratio(F.col("a"), F.col("b")), a="x y z", b="x y z") == 0.0
    assert one(spark, overlap.longest_common_ngram(F.col("a"), F.col("b")), a="x y z", b="q x y") == 2


@pytest.mark.parametrize(
    "mode, content, text, error",
    [
        ("rewrite", '{"neutral_text": " В парке 3 скамьи. "}', "В парке 3 скамьи.", None), ("rewrite", '```JSON\n{"neutral_text": "Да"}```', "Да", None),
        ("brief_v2", '{"topic": "Погода", "facts": ["снег", " ", " лёд"]}', "Topic: Погода\nFacts:\n- снег\n- лёд", None), ("brief_v4", '{"facts": ["x"]}', "Facts:\n- x", None),
        ("brief_v3", '{"topic": "Матч", "entities": ["Клуб"], "numbers": ["2:1"], "facts": ["победа"]}', "Topic: Матч\nEntities:\n- Клуб\nNumbers:\n- 2:1\nFacts:\n- победа", None),
        ("brief_v3", '{"topic": "Матч", "entities": "Клуб"}', None, "invalid_entities"), ("brief", '{"topic": "a", "facts": 5}', None, "invalid_facts"), ("brief", "{", None, "invalid_json"), ("brief_v4", " ", "", None),
    ],
)
def test_payload(spark, mode, content, text, error):
    r = payload.parse(spark.createDataFrame([(content,)], "c string"), "c", mode).first()
    assert (r["parsed"], r["parse_error"]) == (text, error)


def test_usage_and_cost(spark):
    texts = ["x" * 17, " " + "y" * 340 + "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "response_clean string").withColumns(
        {"usage_prompt_tokens": F.lit(None).cast("long"), "usage_completion_tokens": F.lit(None).cast("long"), "cost_usd_estimate": F.lit(None).cast("double")}
    )
    u = [tuple(r["u"]) for r in df.select(cost.estimate_usage(F.col("response_clean")).alias("u")).collect()]
    assert u == [(160, 32, 192), (350, 180, 530)]
    s = cost.summarize(df, "openai/gpt-4.1-mini", True).first()
    assert (s["usage_total_tokens"], s["usage_estimated_records"], s["usage_actual_records"]) == (722, 2, 0)
    assert s["cost_usd_estimate"] == pytest.approx(round(160 * 0.4e-6 + 32 * 1.6e-6, 6) + round(350 * 0.4e-6 + 180 * 1.6e-6, 6))
    assert cost.summarize(df, "unknown", True).first()["cost_usd_estimate"] is None
    said = df.withColumns({"usage_prompt_tokens": F.lit(7).cast("long"), "usage_completion_tokens": F.lit(3).cast("long"), "cost_usd_estimate": F.lit(0.5)})
    s = cost.summarize(said, "openai/gpt-4.1-mini", True).first()
    assert (s["usage_total_tokens"], s["usage_estimated_records"], s["usage_actual_records"], s["cost_usd_estimate"]) == (20, 0, 2, 1.0)
    assert {r["path"]: r["__all"] for r in cost.summarize(said.withColumn("path", F.lit("p")), None, False, ["path"], rollup=True).collect()} == {"p": 0, None: 1}


@settings(max_examples=150, deadline=None)
@given(st.text("abcé ", max_size=14), st.text("abcé ", max_size=14))
def test_fuzzy_matches_definitions(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    assert fuzzy.common_subsequence(a, b) == d[-1][-1]
    runs = [a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b]
    assert fuzzy.common_substring(a, b) == max(map(len, runs), default=0)


def test_indel_is_not_levenshtein():
    assert fuzzy.indel_ratio("ab", "ba") == 50.0 and fuzzy.indel_ratio("abc", "abc") == 100.0


def test_places_of_long_texts():
    """Bits of each character, in time that follows the length."""
    import time

    from textcurate.functions import fuzzy

    assert fuzzy.places("abca😀") == {"a": 0b1001, "b": 0b10, "c": 0b100, "😀": 0b10000} and fuzzy.places("") == {}
    began, long = time.time(), "abcdefghij" * 100_000
    got = fuzzy.places(long)
    assert got["a"].bit_count() == 100_000 and got["j"] >> 999_999 == 1 and time.time() - began < 2
    assert fuzzy.common_subsequence("ajx", long) == 2 and fuzzy.indel_ratio("", "") == 100.0 and fuzzy.common_subsequence("", "x") == 0
