"""Text backends in map-only stages: retries, fallback models, two-pass briefs, resumable runs.

A backend is any picklable callable (model, system, prompt) -> dict with `content` and,
if known, prompt_tokens and completion_tokens; it is called on executors, row by row within
Arrow batches, and is the only thing here that leaves Spark. Errors it raises are classed:
Rejected (provider_rejected), BadRequest (bad_request), TimeoutError and ConnectionError
(transient_error, retried), anything else (api_error).
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cost, overlap, payload, prompts
from ..sources.files import checkpointed, delete
from . import cache as C
from .calls import CallLog, limited
from .posts import ranks

ATTEMPTS = (
    "array<struct<attempt:int,model:string,failed:boolean,failure_reason:string,content:string,"
    "usage_prompt_tokens:long,usage_completion_tokens:long,usage_total_tokens:long,cost_usd_estimate:double>>"
)
PRIMARY, FALLBACK = "openai/gpt-4.1-mini", "openai/gpt-4.1"


class Rejected(Exception):
    pass


class BadRequest(Exception):
    pass


def error_reason(e: Exception) -> str:
    name = type(e).__name__
    if isinstance(e, Rejected):
        return f"provider_rejected:{name}"
    if isinstance(e, BadRequest):
        return f"bad_request:{name}"
    if isinstance(e, (TimeoutError, ConnectionError)):
        return f"transient_error:{name}"
    return f"api_error:{name}"


def call_with_retry(backend: Callable, model: str, system: str, prompt: str, tries: int = 6, wait: float = 2.0, most: float = 60.0, sleep=time.sleep) -> dict:
    """The backend's answer; transient errors are tried again after a jittered, growing pause."""
    for k in range(tries):
        try:
            return backend(model, system, prompt)
        except (TimeoutError, ConnectionError):
            if k == tries - 1:
                raise
            sleep(min(most, random.uniform(0, wait * 2**k)))
    raise AssertionError


def _log(n: int, model: str, answer: dict | None, reason: str | None) -> dict:
    p, c = int((answer or {}).get("prompt_tokens") or 0), int((answer or {}).get("completion_tokens") or 0)
    price = cost.PRICES.get(model)
    return {
        "attempt": n, "model": model, "failed": reason is not None, "failure_reason": reason, "content": (answer or {}).get("content"), "usage_prompt_tokens": p, "usage_completion_tokens": c,
        "usage_total_tokens": int((answer or {}).get("total_tokens") or p + c), "cost_usd_estimate": round(p / 1e6 * price[0] + c / 1e6 * price[1], 6) if price and (p or c) else None,
    }


def _usable(content: str, mode: str) -> str | None:
    """Why an answer can't be used, else None; the same rules as payload.parse."""
    body = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", content.strip(), flags=re.I)).strip()
    if not body:
        return "empty_answer"
    try:
        data = json.loads(body)
    except ValueError:
        return "invalid_json"
    wrong = [k for k, kind in prompts.ANSWER_FIELDS[mode].items() if kind == "array" and not isinstance(data.get(k, []), list)] if isinstance(data, dict) else ["payload"]
    return f"invalid_{wrong[0]}" if wrong else None


def _attempt(backend: Callable, models: tuple[str, ...], system: str, prompt: str, mode: str, retry: dict, log: CallLog | None = None, key: str | None = None) -> list[dict]:
    """The calls of one request: each model in turn until one gives a usable answer; with a log, only those that it lacks are made."""
    made: list[dict] = []
    for model in models:
        n = len(made) + 1

        def call(model: str = model, n: int = n) -> dict:
            try:
                answer = call_with_retry(backend, model, system, prompt, **retry)
                return _log(n, model, answer, _usable(answer.get("content") or "", mode))
            except Exception as e:  # noqa: BLE001  every error becomes a reason in the log
                return _log(n, model, None, error_reason(e))

        made.append(log.once((key, n, model, system, prompt, mode), call) if log else call())
        if not made[-1]["failed"]:
            break
    return made


def attempts(
    df: DataFrame, text: str, backend: Callable, mode: str = "rewrite", models: tuple[str, ...] = (PRIMARY, FALLBACK), fact_limit: int = 5, tries: int = 6,
    to: str = "attempts", concurrency: int = 1, wait: float = 2.0, most: float = 60.0, calls: int | None = None, log: str | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """df with the log of calls of each row.

    A task has up to `concurrency` calls under way at once, so a cluster has that many for
    each of its cores; `calls` limits them for all tasks together (calls.py). Pauses between
    tries grow from `wait` to `most` seconds. log: a folder for answers, so that a call which
    was answered is not made again by a second run of its task; rows of equal `keys` and text
    share answers there (without keys all rows of equal text do).
    """
    if concurrency < 1:
        raise ValueError("concurrency must be positive")
    system, retry = prompts.system_prompt(mode, fact_limit), {"tries": tries, "wait": wait, "most": most}
    kept = CallLog(log) if log else None
    asked = df.withColumn("__prompt", prompts.user_prompt(F.coalesce(F.col(text), F.lit("")), mode, fact_limit))
    asked = asked.withColumn("__key", F.to_json(F.struct(*keys)) if keys else F.lit(None).cast("string"))
    if calls is not None:
        asked, concurrency = limited(asked, calls, concurrency)

    @F.pandas_udf(ATTEMPTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch, own in batches:
                yield pd.Series(list(pool.map(lambda prompt, key: _attempt(backend, models, system, prompt, mode, retry, kept, key), batch, own)), dtype=object)

    return asked.withColumn(to, run("__prompt", "__key")).drop("__prompt", "__key")


def neutralize(
    df: DataFrame, backend: Callable, mode: str = "rewrite", models: tuple[str, ...] = (PRIMARY, FALLBACK), fact_limit: int = 5,
    max_jaccard: float = overlap.MAX_JACCARD, text: str = "response_clean", method: str = "openrouter", concurrency: int = 1,
    calls: int | None = None, log: str | None = None, keys: list[str] | None = None, **limits,
) -> DataFrame:
    """df with candidate, validation, attempts, usage and the synthetic_* fields. Map-only, but for the shuffle that a limit of `calls` asks for."""
    out = attempts(df, text, backend, mode, models, fact_limit, concurrency=concurrency, calls=calls, log=log, keys=keys)
    out = out.withColumn("__best", C.best_attempt(F.col("attempts")))
    out = payload.parse(out.withColumn("__content", F.col("__best.content")), "__content", mode, to="candidate", error="__error")
    out = overlap.with_validation(out, text, "candidate", max_jaccard=max_jaccard, **limits)
    why = F.coalesce(F.col("__best.failure_reason"), F.col("__error"), F.col("validation.failure_reason"))
    usage = C.rollup_attempts(F.col("attempts"), models[0])
    out = out.withColumns({"failure_reason": why, "usage": usage, "neutralizer_final_model": F.col("__best.model"), "neutralizer_primary_model": F.lit(models[0])})
    failed = F.col("failure_reason").isNotNull()
    out = out.withColumns(
        {
            "synthetic_input": F.when(failed, "").otherwise(F.col("validation.neutralized_clean")), "synthetic_ok": ~failed, "synthetic_failed": failed,
            "synthetic_method": F.lit(method), "synthetic_model": F.col("neutralizer_final_model"), "jaccard": F.when(~failed, F.col("validation.jaccard")),
        }
    )
    return out.drop("__best", "__content", "__error")


def two_pass_brief(
    df: DataFrame, backend: Callable, models: tuple[str, ...] = (PRIMARY, FALLBACK), fact_limit: int = 4, max_jaccard: float = overlap.MAX_JACCARD,
    text: str = "response_clean", **shared,
) -> DataFrame:
    """Extract a structured brief, compress it, validate with and without copy limits, rewrite once where needed, keep the better.

    Adds final (a validation struct), used_postedit, used_two_pass and the usage of all calls.
    Calls are made here, once: their rows are kept as checkpoints. shared: concurrency, calls,
    log and keys of attempts().
    """
    one = payload.parse(C_content(attempts(df, text, backend, "brief_v3", models, fact_limit, to="a1", **shared), "a1", "c1"), "c1", "brief_v3", to="p1", error="e1")
    two = payload.parse(C_content(attempts(one, "p1", backend, "brief_v4", models, fact_limit, to="a2", **shared), "a2", "c2"), "c2", "brief_v4", to="p2", error="e2")
    two = overlap.with_validation(overlap.with_validation(two, text, "p2", max_jaccard=max_jaccard, to="base"), text, "p2", max_jaccard=max_jaccard, to="strict", **overlap.STRICT)
    # both branches below read these rows: the calls so far must not be made again
    two = checkpointed(two.withColumn("used_postedit", overlap.should_postedit(F.col("base"), F.col("strict"))))
    # only rows that need a further pass carry a prompt; the others' call list stays empty
    edit = attempts(two.where("used_postedit"), "p2", backend, "brief_v4", models, fact_limit, to="a3", **shared)
    skip = two.where("not used_postedit").withColumn("a3", F.array().cast(ATTEMPTS))
    three = payload.parse(C_content(edit.unionByName(skip), "a3", "c3"), "c3", "brief_v4", to="p3", error="e3")
    three = checkpointed(overlap.with_validation(three, text, "p3", max_jaccard=max_jaccard, to="edited", **overlap.STRICT))
    final = F.when(F.col("used_postedit"), overlap.better_validation(F.col("strict"), F.col("edited"))).otherwise(F.col("strict"))
    out = three.withColumn("final", final).withColumn("attempts", F.concat("a1", "a2", "a3"))
    out = out.withColumn("usage", C.rollup_attempts(F.col("attempts"), models[0])).withColumn("used_two_pass", F.lit(True))
    return out.drop("a1", "a2", "a3", "c1", "c2", "c3", "e1", "e2", "e3")


def C_content(df: DataFrame, log: str, to: str) -> DataFrame:
    return df.withColumn(to, C.best_attempt(F.col(log))["content"])


def generate(df: DataFrame, prompt: str, generator: Callable[[list[str]], list[str]], to: str = "generated") -> DataFrame:
    """df with one completion of each prompt; the generator gets a batch and is shipped to workers once."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(generator(b.fillna("").tolist()), dtype=object)

    return df.withColumn("__full", run(prompt)).withColumn(to, prompts.extract_response(F.col("__full"))).drop("__full")


def run_resumable(records: DataFrame, cache_path: str, backend: Callable, keys: list[str], target: int | None = None, chunk: int = 500, order=None, **options) -> DataFrame:
    """Neutralise records that the Parquet cache lacks, newest first, chunk by chunk; returns the cache's rows of the records.

    Every finished chunk is appended as files of its own, so a run that stops goes on where
    it stopped. Within a chunk, answers are logged beside the cache until the chunk is written,
    so a task or a run that is started again makes no answered call twice. With a target the
    run ends once so many rows are ok.
    """
    from pyspark.errors import AnalysisException

    spark = records.sparkSession

    def load():
        try:
            return spark.read.parquet(cache_path)
        except AnalysisException:
            return None

    have, wanted = load(), records.select(*keys).distinct()
    todo = C.pending(records, have, keys) if have is not None else records
    order = order if order is not None else [F.col("date").desc_nulls_last(), *[F.col(k) for k in keys]]
    ok = have.join(wanted, keys, "left_semi").where("synthetic_ok").count() if have is not None else 0
    # ordered once; a chunk is a range of positions, and its own rows tell how many are ok
    ranked, log = checkpointed(ranks(todo, [], order, "__rank").drop("total")), cache_path.rstrip("/") + ".calls"
    for start in range(0, ranked.count(), chunk):
        if target is not None and ok >= target:
            break
        part = neutralize(ranked.where((F.col("__rank") > start) & (F.col("__rank") <= start + chunk)).drop("__rank"), backend, log=log, keys=keys, **options)
        part = checkpointed(part)  # the calls are made here
        part.write.mode("append").parquet(cache_path)
        delete(log)
        ok += part.where("synthetic_ok").count()
    have = load()
    return records.limit(0) if have is None else have.join(wanted, keys, "left_semi")
