"""Queries over files that Spark writes from the tables and reads again, and over texts compared in pairs, with their DuckDB twins.

Each sink writes below the folder in spark.checkpoint.dir, in a folder of its own a call.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy, prompts
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import generation as G
from ..operators import nearest as N
from ..operators import posts as P
from ..sources import files, readers, writers
from . import pipelines, sql
from .catalogue import _QUOTA, _SPLIT, _sql_text, query, splits, table


@query("select doc_id, lang, source, n_chars, text is null as no_text, md5(coalesce(text, '')) as text from documents")
def jsonl_round_trip(spark, sf_dir):
    """JSON lines written with nulls kept, read with their schema."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"), files.scratch(spark, "jsonl")
    writers.write_jsonl(d, path)
    back = readers.read_jsonl(spark, path, "doc_id long, lang string, source string, n_chars long, text string")
    return back.select("doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("no_text"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query("select lang, count(*) as n from documents group by lang")
def field_of_jsonl(spark, sf_dir):
    """One field of JSON lines; the others aren't read."""
    path = files.scratch(spark, "field")
    writers.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return readers.read_field(spark, path, "lang").groupBy("lang").agg(F.count("*").alias("n"))


@query("select doc_id, n_chars, md5(text) as text from documents where text <> ''")
def csv_round_trip(spark, sf_dir):
    """Texts of several lines, quotes and commas as CSV and back, types inferred."""
    path = files.scratch(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", "n_chars"), path)
    back = readers.read_optional(spark, path, "csv")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.md5("text").alias("text"))


@query(f"with {_SPLIT} select style_type, split, count(*) as n, min(post_id) as first_id, max(post_id) as last_id from split where style_type is not null and split in ('val', 'test') group by 1, 2")
def split_files(spark, sf_dir):
    """A folder for each style type and split; two splits of each type are read alone, a type that isn't there is skipped."""
    rows, path = splits(spark, sf_dir).where("style_type is not null").select("post_id", "text", "style_type", "split"), files.scratch(spark, "splits")
    writers.write_splits(rows, path)
    kinds = [r["lang"] for r in table(spark, sf_dir, "documents").select("lang").distinct().where("lang is not null").collect()]  # languages
    parts = [readers.read_split(spark, path, kind, split) for kind in [*kinds, "no such type"] for split in ("val", "test")]
    out: DataFrame | None = None
    for p in (p for p in parts if p is not None):
        out = p if out is None else out.unionByName(p)
    return out.groupBy("style_type", "split").agg(F.count("*").alias("n"), F.min("post_id").alias("first_id"), F.max("post_id").alias("last_id"))


@query(
    """with l as (select doc_id, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') as line from documents)
    select cast(row_number() over (order by doc_id) - 1 as bigint) as pos, md5(line) as line from l where trim(line) <> ''"""
)
def lines_in_order(spark, sf_dir):
    """Documents as lines, written by several tasks in order and read in splits with their positions."""
    d, path = table(spark, sf_dir, "documents"), files.scratch(spark, "lines")
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]+", " ")
    d.select("doc_id", line.alias("line")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("line").write.text(path)
    return readers.read_lines(spark, path).select("pos", F.md5("text").alias("line"))


@query(f"with t as (select doc_id, {sql.strip('text')} as t from documents) select cast(row_number() over (order by doc_id) - 1 as bigint) as pos, md5(t) as text from t where t <> ''")
def blocks_in_order(spark, sf_dir):
    """Documents as generated blocks: part files in order, read back in splits, blank ones dropped."""
    path = files.scratch(spark, "blocks")
    writers.write_blocks(table(spark, sf_dir, "documents"), path, {"model": "none"}, "text", "doc_id")
    return readers.read_blocks(spark, path).select("pos", F.md5("text").alias("text"))


@query(
    """select doc_id, case when doc_id % 3 = 0 then 'second' else 'first' end as source, case when doc_id % 3 = 0 then 2 * n_chars else n_chars end as n from documents
    union all select -doc_id, 'second', n_chars from documents where doc_id % 50 = 1"""
)
def later_caches_win(spark, sf_dir):
    """Rows of two cache files by key: the later file's count, and a file that isn't there is passed over."""
    d, at = table(spark, sf_dir, "documents"), files.scratch(spark, "caches")
    one = d.select("doc_id", F.lit("first").alias("source"), F.col("n_chars").cast("long").alias("n"))
    two = d.where("doc_id % 3 = 0").select("doc_id", F.lit("second").alias("source"), (2 * F.col("n_chars")).cast("long").alias("n"))
    more = d.where("doc_id % 50 = 1").select((-F.col("doc_id")).alias("doc_id"), F.lit("second").alias("source"), F.col("n_chars").cast("long").alias("n"))
    writers.write_jsonl(one, f"{at}/a")
    writers.write_jsonl(two.unionByName(more), f"{at}/b")
    return readers.read_caches(spark, [f"{at}/a", f"{at}/none", f"{at}/b"], ["doc_id"], "doc_id long, source string, n long")


@query(f"with {_SPLIT} select 'own' as kind, post_id from split where split = 'val' and channel = (select min(channel) from split where split = 'val') union all select 'fallback', post_id from split where split = 'val'")
def validation_fallback(spark, sf_dir):
    """Validation rows of an input source, and of a source that has none: then all."""
    val = splits(spark, sf_dir).where("split = 'val'").withColumn("input_source", F.col("channel"))
    first = val.agg(F.min("channel")).first()[0]
    parts = [P.validation_rows(val, source, "all").select(F.lit(kind).alias("kind"), "post_id") for kind, source in (("own", first), ("fallback", "no such source"))]
    return parts[0].unionByName(parts[1])


@query(
    f"""with {_QUOTA}, m as (select * from quota qualify row_number() over (partition by style_type order by case when r <= q then 0 else 1 end, k, post_id) <= 20)
    select style_type || ':' || post_id as pilot_id, char_len_q, stratum, 2 as reads from m"""
)
def saved_manifest(spark, sf_dir):
    """The pilot manifest, built and saved by the first call and read by the second."""
    d, path = table(spark, sf_dir, "documents"), files.scratch(spark, "manifest")
    rows = T.features(d.select(F.col("doc_id").alias("post_id"), F.col("doc_id").cast("string").alias("date"), F.col("lang").alias("style_type"), F.col("text").alias("response_clean"), F.lit("val").alias("split")), "response_clean")
    both = [pipelines.load_or_build_manifest(spark, path, rows, 20).select("pilot_id", "char_len_q", "stratum") for _ in range(2)]
    return both[0].unionByName(both[1]).groupBy("pilot_id", "char_len_q", "stratum").agg(F.count("*").cast("int").alias("reads"))


def _terse(model: str, system: str, prompt: str) -> dict:
    """Answers with the item's number; refuses every third item, and the first model fails on every seventh."""
    number = int(prompt.split("item no ", 1)[1].split(" ", 1)[0])
    if number % 3 == 0:
        raise G.Rejected
    if number % 7 == 0 and model == G.PRIMARY:
        return {"content": "not json"}
    return {"content": json.dumps({"neutral_text": f"item {number}"})}


@query(
    """with r as (select doc_id, (row_number() over (order by doc_id desc) - 1) // 250 as chunk, cast(doc_id % 3 <> 0 as int) as ok from documents),
    s as (select chunk, sum(ok) as ok from r group by chunk), b as (select chunk, coalesce(sum(ok) over (order by chunk rows between unbounded preceding and 1 preceding), 0) as before from s)
    select doc_id as post_id, ok = 1 as synthetic_ok, case when doc_id % 3 = 0 or doc_id % 7 = 0 then 2 else 1 end as n_attempts from r join b using (chunk) where before < 400"""
)
def resumable_until_target(spark, sf_dir):
    """Newest records first, chunk by chunk, until 400 are ok; a second run finds the target met and calls nothing."""
    text = F.concat(F.lit("item no "), F.col("doc_id"), F.lit(" of the list has some more words to say"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("doc_id").alias("date"), text.alias("response_clean"))
    path = files.scratch(spark, "resumable")
    for _ in range(2):
        out = G.run_resumable(d, path, _terse, ["post_id"], target=400, chunk=250, calls=4, concurrency=2)
    return out.select("post_id", "synthetic_ok", F.size("attempts").alias("n_attempts"))


@query(
    """with l as (select 'by language' as kind, coalesce(lang, 'none') as style_type, text from documents union all select 'one language', 'all', text from documents where lang = 'en')
    select kind, style_type, count(*) as n, min(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as char_min from l group by 1, 2"""
)
def length_report_guard(spark, sf_dir):
    """Lengths of each style type, or of all together where there is only one."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("style_type"), "text")
    both = (("by language", E.length_report(d)), ("one language", E.length_report(d.where("style_type = 'en'"))))
    parts = [r.select(F.lit(kind).alias("kind"), "style_type", "n", F.col("char_min").cast("long").alias("char_min")) for kind, r in both]
    return parts[0].unionByName(parts[1])


def _common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of at most 60 characters, a's places being the bits of a number."""
    masks = f"list_transform(string_split({b}, ''), lambda c: cast(coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: case when {a}[i] = c then cast(1 as hugeint) << cast(i - 1 as int) else 0 end)), 0) as hugeint))"
    full = f"((cast(1 as hugeint) << cast(length({a}) as int)) - 1)"
    step = f"lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), {step})))"


def _run(a: str, b: str) -> str:
    """Length of the longest run of characters that two texts share."""
    ends = f"list_filter(range(1, length({a}) + 1), lambda n: n + i - 1 <= length({a}) and contains({b}, substr({a}, cast(i as bigint), cast(n as bigint))))"
    return f"coalesce(list_max(list_transform(range(1, length({a}) + 1), lambda i: coalesce(list_max({ends}), 0))), 0)"


@query(
    f"""with p as (select x.p_partkey, x.p_name as a, y.p_name as b from part x join part y on y.p_partkey = x.p_partkey + 1)
    select p_partkey, round(200.0 * {_common('a', 'b')} / (length(a) + length(b)), 4) as ratio, cast({_run('a', 'b')} as integer) as run from p"""
)
def fuzzy_pairs(spark, sf_dir):
    """Edit ratio and longest common run of the names of neighbouring parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return both.select("p_partkey", F.round(fuzzy.indel_ratio_udf("a", "b"), 4).alias("ratio"), fuzzy.common_substring_udf("a", "b").alias("run"))


_NAMES = f"""q as (select s_suppkey as q, lower(s_name) as a from supplier), c as (select p_partkey as id, lower(p_name) as b from part),
scored as (select q, id, a, b, 200.0 * {_common('a', 'b')} / (length(a) + length(b)) as f from q, c),
best as (select * from scored qualify row_number() over (partition by q order by f desc, id) = 1),
w as (select *, string_split(a, ' ') as wa, string_split(b, ' ') as wb from best),
g as (select *, case when len(wa) < 5 then list_distinct(wa) else list_distinct(list_transform(range(1, len(wa) - 3), lambda i: array_to_string(wa[i:i + 4], ' '))) end as ga,
  case when len(wb) < 5 then list_distinct(wb) else list_distinct(list_transform(range(1, len(wb) - 3), lambda i: array_to_string(wb[i:i + 4], ' '))) end as gb from w),
found as (select q as query_id, id as nearest_id, round(f, 4) as fuzz_ratio, round(len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))), 4) as jaccard_5gram, cast({_run('a', 'b')} as integer) as longest_common_chars from g)"""


def names_nearest(spark, sf_dir) -> DataFrame:
    return N.nearest_texts(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"), "s_suppkey", "s_name", "p_partkey", "p_name", whole_bytes=N.WHOLE_BYTES)


@query(f"with {_NAMES} select * from found")
def nearest_names(spark, sf_dir):
    """For each supplier's name the nearest name of a part."""
    return names_nearest(spark, sf_dir)


@query(f"with {_NAMES} select query_id, nearest_id, fuzz_ratio from found order by fuzz_ratio desc, query_id limit 5")
def nearest_names_top(spark, sf_dir):
    """The five nearest of them."""
    return names_nearest(spark, sf_dir).orderBy(F.desc("fuzz_ratio"), "query_id").limit(5).select("query_id", "nearest_id", "fuzz_ratio")


@query(
    f"""with {_NAMES}, s as (
      select count(*) as n, count(*) filter (where fuzz_ratio = 100) as n_exact, count(*) filter (where longest_common_chars >= 30) as n_long, median(fuzz_ratio) as fuzz_median, max(fuzz_ratio) as fuzz_max,
        median(jaccard_5gram) as jaccard_median, max(jaccard_5gram) as jaccard_max, median(longest_common_chars) as run_median, max(longest_common_chars) as run_max from found)
    select n, n_exact, n_long, round(fuzz_median, 6) as fuzz_median, fuzz_max, round(jaccard_median, 6) as jaccard_median, jaccard_max, run_median, run_max, fuzz_median < 60 and fuzz_max < 100 and run_max < 30 as passed from s"""
)
def nearest_names_summary(spark, sf_dir):
    """Exact and long matches, medians, maxima and the verdict for them."""
    return E.memorisation_summary(names_nearest(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("fuzz_median", "jaccard_median")})


@query(
    """with w as (select doc_id, unnest(regexp_split_to_array(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) as word from documents where text is not null),
    p as (select doc_id, ' ' || word || ' ' as p, count(*) as c from w where word <> '' group by all),
    sized as (select doc_id, p, c, unnest([2, 3, 4]) as n from p), kept as (select * from sized where length(p) > n or n = 2 or length(p) > n - 1),
    g as (select doc_id, c, unnest(case when length(p) <= n then [p] else list_transform(range(1, length(p) - n + 2), lambda i: substr(p, cast(i as bigint), cast(n as bigint))) end) as gram from kept),
    t as (select gram, sum(c) as times, count(distinct doc_id) as texts from g group by gram)
    select gram, cast(times as bigint) as times, cast(texts as bigint) as texts from t qualify row_number() over (order by times desc, gram) <= 50000"""
)
def style_vocabulary(spark, sf_dir):
    """The 50,000 most frequent n-grams that the style classifier weighs, with the texts that hold them."""
    return E.StyleClassifier(["x"]).vocabulary(table(spark, sf_dir, "documents"), "text")


def _counting(texts: list[str]) -> list[str]:
    """A generator that continues each prompt with its length."""
    return [f"{t} {len(t)} characters</s>" for t in texts]


_PROMPT = "replace(replace(" + _sql_text(prompts.PROMPT) + ", '{instruction}', replace(" + _sql_text(prompts.INSTRUCTION) + ", '{style_type}', role)), '{input}', text)"


@query(f"select conv_id, turn, length({_PROMPT}) || ' characters' as response from conversations")
def generated_responses(spark, sf_dir):
    """Completions of a prompt for each turn, without prompt and end marks."""
    c = table(spark, sf_dir, "conversations").withColumn("prompt", prompts.inference_prompt(F.col("role"), F.col("text")))
    return G.generate(c, "prompt", _counting, "response").select("conv_id", "turn", "response")
