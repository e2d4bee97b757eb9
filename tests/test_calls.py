"""The limit of calls for a whole run, and calls that are made once although tasks are run again."""

import json
import os
import time

import pytest

from textcurate.operators import calls, generation as G

ANSWER = json.dumps({"text": "plain words"})


def watched(folder):
    """A backend that notes when each call begins and ends, in files of its own, as tasks share no memory."""

    def backend(model, system, prompt):
        began = time.time()
        time.sleep(0.15)
        with open(f"{folder}/{os.getpid()}-{time.time_ns()}", "w") as f:
            f.write(f"{began} {time.time()}")
        return {"content": ANSWER}

    return backend


def most_at_once(folder):
    spans = [tuple(map(float, open(f"{folder}/{f}").read().split())) for f in os.listdir(folder)]
    return max(sum(a <= x < b for a, b in spans) for x, _ in spans), len(spans)


@pytest.mark.parametrize("limit, concurrency", [(3, 1), (3, 2), (3, 5), (1, 4)])
def test_limit_for_the_run(spark, tmp_path, limit, concurrency):
    rows = spark.range(24).selectExpr("id as post_id", "concat('text ', id) as response_clean").repartition(8)
    out = G.attempts(rows, "response_clean", watched(str(tmp_path)), concurrency=concurrency, calls=limit)
    assert out.count() == 24 and out.rdd.getNumPartitions() * min(concurrency, limit) <= limit
    assert len(out.select("attempts").collect()) == 24
    most, n = most_at_once(tmp_path)
    assert 1 <= most <= limit and n >= 24
    with pytest.raises(ValueError):
        calls.limited(rows, 0, 1)


def test_chained_calls_share_the_limit(spark, tmp_path):
    rows = spark.range(8).selectExpr("id as post_id", "concat('text ', id) as response_clean").repartition(8)
    assert G.two_pass_brief(rows, watched(str(tmp_path)), calls=3).count() == 8
    most, n = most_at_once(tmp_path)
    assert most <= 3 and n >= 16


def dying(folder, after):
    """A backend whose worker dies in the call after so many, once."""

    def backend(model, system, prompt):
        made = len(os.listdir(f"{folder}/made"))
        flag = f"{folder}/died"
        if made >= after and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        with open(f"{folder}/made/{time.time_ns()}-{os.getpid()}", "w") as f:
            f.write(prompt)
        return {"content": ANSWER, "prompt_tokens": 3}

    return backend


def test_answered_calls_are_not_made_again(spark, tmp_path):
    (tmp_path / "made").mkdir()
    rows = spark.range(20).selectExpr("id as post_id", "concat('text ', id) as response_clean").coalesce(1)
    out = G.attempts(rows, "response_clean", dying(str(tmp_path), 12), log=str(tmp_path / "log"), keys=["post_id"])
    with pytest.raises(Exception):  # local tests don't run a task again by themselves
        out.collect()
    assert len(os.listdir(tmp_path / "made")) == 12
    told = {r["post_id"]: r["attempts"] for r in out.collect()}
    assert len(told) == 20 and all(len(a) == 1 and a[0]["usage_prompt_tokens"] == 3 for a in told.values())
    asked = [(tmp_path / "made" / f).read_text() for f in os.listdir(tmp_path / "made")]
    assert len(asked) == len(set(asked)) == 20
    assert out.count() == 20 and len(os.listdir(tmp_path / "made")) == 20  # a third run asks nothing


def test_resumable_run_after_a_crash(spark, tmp_path):
    (tmp_path / "made").mkdir()
    df = spark.range(9).selectExpr("id as post_id", "concat('some text ', id) as response_clean", "cast(id as string) as date", "'val' as split", "'type1' as style_type")
    cache, backend = str(tmp_path / "cache"), dying(str(tmp_path), 5)
    with pytest.raises(Exception):
        G.run_resumable(df, cache, backend, ["post_id"], chunk=4)
    assert G.run_resumable(df, cache, backend, ["post_id"], chunk=4).count() == 9
    asked = [(tmp_path / "made" / f).read_text() for f in os.listdir(tmp_path / "made")]
    assert len(asked) == len(set(asked)) and not os.path.exists(cache + ".calls")
