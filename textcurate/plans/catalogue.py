"""The queries over the standard tables that show every operator, with their DuckDB twins.

documents stand for posts (doc_id: key and time, lang: style type, source: channel), a fixed
rewriting of them for generated text, conversations for prompts and answers, events for
attempts, labels for acceptance, embeddings for sentence vectors, benchmark for held-out text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cost, overlap, payload, prompts
from ..functions import text as T
from ..operators import cache as C
from ..operators import evaluation as E
from ..operators import generation as G
from ..operators import nearest as N
from ..operators import posts as P
from ..operators import sampling as S
from ..operators.quantiles import summaries
from ..sources import files, keyed_cache, readers
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("post_id"), F.col("doc_id").alias("date"), "text", F.col("source").alias("channel"), F.col("lang").alias("style_type"))


_POSTS = "posts as (select doc_id as post_id, doc_id as date, text, source as channel, lang as style_type from documents)"
_FILTERED = f"{_POSTS}, filtered as (select * from (select post_id, date, {sql.strip('text')} as text, channel, style_type from posts) where length(text) >= 50)"
_DEDUP = f"{_FILTERED}, dedup as (select * from filtered qualify row_number() over (partition by {sql.text_hash('text')} order by date, post_id) = 1)"
_SPLIT = f"""{_DEDUP}, ranked as (select *, row_number() over (partition by style_type order by date, post_id) as r, count(*) over (partition by style_type) as n from dedup),
split as (select * exclude (r, n), case when r <= floor(n * 0.8) then 'train' when r <= floor(n * 0.9) then 'val' else 'test' end as split from ranked)"""


def deduplicated(spark, sf_dir):
    return P.dedup_keep_earliest(P.filter_min_chars(posts(spark, sf_dir)))


def splits(spark, sf_dir):
    return P.temporal_split(deduplicated(spark, sf_dir), ["style_type"])


@query(f"with {_FILTERED} select post_id, length(text) as n, md5(text) as text_md5 from filtered")
def filter_min_chars(spark, sf_dir):
    return P.filter_min_chars(posts(spark, sf_dir)).select("post_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


@query(f"with {_POSTS} select post_id, {sql.text_hash('text')} as h from posts")
def normalized_hash(spark, sf_dir):
    return posts(spark, sf_dir).select("post_id", T.text_hash(F.col("text")).alias("h"))


@query(f"with {_DEDUP} select post_id, md5(text) as text_md5 from dedup")
def dedup_keep_earliest(spark, sf_dir):
    return deduplicated(spark, sf_dir).select("post_id", F.md5("text").alias("text_md5"))


@query(f"with {_POSTS} select {sql.text_hash('text')} as group_id, count(*) as n, min(post_id) as first_id from posts group by 1 having count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return posts(spark, sf_dir).groupBy(T.text_hash(F.col("text")).alias("group_id")).agg(F.count("*").alias("n"), F.min("post_id").alias("first_id")).where("n > 1")


@query(f"with {_POSTS} select channel, post_id from posts qualify row_number() over (partition by channel order by date desc nulls last, post_id desc) <= 10")
def sample_recent_per_source(spark, sf_dir):
    return P.sample_recent(posts(spark, sf_dir), 10, ["channel"]).select("channel", "post_id")


@query(f"with {_SPLIT} select post_id, style_type, split from split")
def temporal_split(spark, sf_dir):
    return splits(spark, sf_dir).select("post_id", "style_type", "split")


@query(f"with {_SPLIT} select channel, split, count(*) as n from split group by 1, 2")
def split_counts(spark, sf_dir):
    return splits(spark, sf_dir).groupBy("channel", "split").agg(F.count("*").alias("n"))


@query(
    f"""with {_SPLIT} select style_type, count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'val') as n_val,
    count(*) filter (where split = 'test') as n_test, count(*) as total, min(date) as first, max(date) as last from split group by 1"""
)
def split_report(spark, sf_dir):
    return P.split_report(splits(spark, sf_dir))


@query(
    f"""with {_POSTS} select post_id, length(text) as char_len, len(regexp_extract_all(text, chr(10) || chr(10))) + 1 as n_paragraphs, regexp_matches(text, '[\\x{{1F600}}-\\x{{1FAFF}}]') as has_emoji,
    ends_with({sql.rstrip('text')}, '?') as ends_with_question, {sql.text_hash('text')} as source_text_hash, {sql.text_hash('text')} as group_id from posts"""
)
def text_features(spark, sf_dir):
    out = T.features(posts(spark, sf_dir))
    return out.select("post_id", F.col("char_len").cast("long").alias("char_len"), F.col("n_paragraphs").cast("long").alias("n_paragraphs"), "has_emoji", "ends_with_question", "source_text_hash", "group_id")


@query(f"select doc_id, md5({sql.clean('text')}) as cleaned, length({sql.clean('text')}) as n from documents")
def clean_for_input(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("t"))
    return c.select("doc_id", F.md5("t").alias("cleaned"), F.length("t").cast("long").alias("n"))


_URL = "html || ' ' || url || ' @someone #tag'"


@query(f"select page_id, md5({sql.clean(_URL)}) as cleaned from pages")
def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean(F.concat("html", F.lit(" "), "url", F.lit(" @someone #tag")))).alias("cleaned"))


_CTA = "(case when doc_id % 3 = 0 then text || chr(10) || 'ПОДПИСЫВАЙТЕСЬ на канал' || chr(10) || 'конец' else text end)"


@query(f"select doc_id, md5({sql.strip_cta(_CTA)}) as body from documents")
def strip_cta_lines(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nПОДПИСЫВАЙТЕСЬ на канал\nконец"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_cta(t)).alias("body"))


@query(f"select doc_id, len({sql.sentences('text')}) as n, md5(array_to_string({sql.sentences('text')}, '|')) as s from documents")
def sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("s"))


@query(f"select doc_id, {sql.heuristic_brief('text')} as brief from documents")
def heuristic_brief(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.heuristic_brief(F.col("text")).alias("brief"))


@query(f"select page_id, len({sql.paragraphs('html')}) as n, md5(array_to_string({sql.paragraphs('html')}, '|')) as p from pages")
def paragraphs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", T.paragraphs(F.col("html")).alias("p"))
    return p.select("page_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("p"))


@query(f"select doc_id, array_to_string(list_sort({sql.numbers('text')}), ' ') as numbers from documents")
def extract_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.numbers(F.col("text"))), " ").alias("numbers"))


@query(f"select doc_id, len({sql.tokens('text')}) as n_words, len({sql.word_set('text')}) as n_distinct, {sql.blank_words('text')} as n_blank from documents")
def word_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(t)).cast("long").alias("n_words"), F.size(T.word_set(t)).cast("long").alias("n_distinct"), T.blank_words(t).cast("long").alias("n_blank"))


def rewritten(spark, sf_dir):
    """Posts with a fixed rewriting as `candidate` and its failure flag."""
    k = F.col("doc_id") % 5
    cand = (
        F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit(" the "), F.lit(" a "))).when(k == 2, F.concat(F.lit("Topic: "), F.substring_index("text", ".", 2)))
        .when(k == 3, F.lit("нейтральный пересказ без чисел")).otherwise("")
    )
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("post_id"), F.col("lang").alias("style_type"), F.col("text").alias("response_clean"), cand.alias("candidate"))


_PAIRS = """pairs as (select doc_id as post_id, lang as style_type, text as response_clean, case doc_id % 5 when 0 then text when 1 then replace(text, ' the ', ' a ')
when 2 then 'Topic: ' || array_to_string(string_split(text, '.')[1:2], '.') when 3 then 'нейтральный пересказ без чисел' else '' end as candidate from documents)"""


@query(
    f"""with {_PAIRS}, s as (select *, {sql.jaccard('response_clean', 'candidate')} as j from pairs)
    select post_id, round(j, 4) as jaccard, {sql.jaccard_bin('j')} as bin, round(length(candidate) / greatest(length(response_clean), 1), 4) as length_ratio from s"""
)
def jaccard_pairs(spark, sf_dir):
    p = rewritten(spark, sf_dir).withColumn("j", overlap.jaccard(F.col("response_clean"), F.col("candidate")))
    return p.select("post_id", F.round("j", 4).alias("jaccard"), overlap.jaccard_bin(F.col("j")).alias("bin"), F.round(overlap.length_ratio(F.col("response_clean"), F.col("candidate")), 4).alias("length_ratio"))


@query(f"with {_PAIRS} select post_id, {sql.numbers_preserved('response_clean', 'candidate')} as kept from pairs")
def number_preservation(spark, sf_dir):
    return rewritten(spark, sf_dir).select("post_id", overlap.numbers_preserved(F.col("response_clean"), F.col("candidate")).alias("kept"))


@query(
    f"""with {_PAIRS}, t as (select post_id, {sql.tokens('response_clean')} as a, {sql.tokens('candidate')} as b from pairs), {sql.overlap_ctes('t', 'post_id', 'a', 'b')}
    select post_id, longest, round(copied, 4) as copied from ngram_overlap"""
)
def ngram_overlap(spark, sf_dir):
    a, b = F.col("response_clean"), F.col("candidate")
    return rewritten(spark, sf_dir).select("post_id", overlap.longest_common_ngram(a, b).alias("longest"), F.round(overlap.copied_ngram_ratio(a, b), 4).alias("copied"))


def _cascade(strict: bool) -> str:
    more = " when n >= 5 then 'copied_span' when r >= 0.25 then 'copied_4gram_ratio'" if strict else ""
    return f"""{_PAIRS}, cl as (select *, {sql.clean('candidate')} as c from pairs),
    tk as (select *, {sql.tokens('response_clean')} as ta, {sql.tokens('c')} as tb from cl), {sql.overlap_ctes('tk', 'post_id', 'ta', 'tb')},
    m as (select tk.*, {sql.set_jaccard('list_distinct(ta)', 'list_distinct(tb)')} as jr, o.longest as n, o.copied as r, {sql.strip('c')} = {sql.strip('response_clean')} as same,
      {sql.numbers_preserved('response_clean', 'c')} as num from tk join ngram_overlap o on o.post_id = tk.post_id),
    w as (select *, case when c = '' then 'empty_after_clean' when not num then 'numbers_not_preserved' when same then 'identity'
      when coalesce(nullif(round(jr, 4), 0.0), 1.0) >= 0.5 then 'high_overlap'{more} else null end as why from m),
    validated as (select post_id, style_type, response_clean, case when why is null then c else '' end as neutralized_clean, why is not null as failed, why as failure_reason,
      case when why in ('numbers_not_preserved', 'identity') then null else n end as longest_common_ngram, case when why in ('numbers_not_preserved', 'identity') then null else round(r, 4) end as copy_ngram_ratio,
      case when why is null then round(jr, 4) end as jaccard, why is null and same as is_identity, why is null and num as numbers_preserved,
      case when why is null then round(length(c) / greatest(length(response_clean), 1), 4) end as length_ratio,
      case when why is null then {sql.jaccard_bin('jr')} end as jaccard_bin, case when why is null then length(c) / greatest(length(response_clean), 1) < 0.4 end as length_collapse from w)"""


_VALID = "post_id, md5(neutralized_clean) as neutralized, failed, failure_reason, coalesce(longest_common_ngram, -1) as longest_common_ngram, copy_ngram_ratio, jaccard, is_identity, numbers_preserved, length_ratio, numbers_preserved as numbers_ok, is_identity as identity, jaccard_bin, length_collapse"


def validated(spark, sf_dir, **limits):
    v = overlap.with_validation(rewritten(spark, sf_dir), "response_clean", "candidate", **limits)
    return v.select("post_id", "style_type", "response_clean", "validation.*")


def _validation_columns(df):
    return df.select(
        "post_id", F.md5("neutralized_clean").alias("neutralized"), "failed", "failure_reason", F.coalesce("longest_common_ngram", F.lit(-1)).alias("longest_common_ngram"), "copy_ngram_ratio", "jaccard", "is_identity", "numbers_preserved",
        "length_ratio", "quality_flags.numbers_ok", "quality_flags.identity", "quality_flags.jaccard_bin", "quality_flags.length_collapse",
    )


@query(f"with {_cascade(False)} select {_VALID} from validated")
def validate_cascade(spark, sf_dir):
    return _validation_columns(validated(spark, sf_dir))


@query(f"with {_cascade(True)} select {_VALID} from validated")
def validate_strict(spark, sf_dir):
    return _validation_columns(validated(spark, sf_dir, **overlap.STRICT))


def _summary(by: str = "") -> str:
    live = lambda c, more="": f"round(avg(case when not failed {more} then coalesce(cast({c} as int), 0) end), 4)"
    key = f"{by}, " if by else ""
    return f"""select {key}count(*) as n_total, count(*) filter (where not failed) as n_active, round(avg(cast(failed as int)), 4) as failed_rate, {live('(jaccard >= 0.5)')} as jaccard_ge_0_5,
    {live('is_identity')} as identity_rate, {live('numbers_preserved', "and regexp_matches(response_clean, '[0-9]')")} as number_preservation, {live('(length_ratio < 0.4)')} as length_collapse_rate,
    {live('(jaccard < 0.3 and not is_identity)')} as good_neutral_rate, round(avg(case when not failed then length_ratio end), 4) as mean_length_ratio from validated {'group by ' + by if by else ''}"""


@query(f"with {_cascade(False)} {_summary()}")
def quality_summary(spark, sf_dir):
    return E.summarize_quality(validated(spark, sf_dir, ngrams=False), "failed")


@query(
    f"""with {_cascade(False)}, s as ({_summary('style_type')}) select style_type, jaccard_ge_0_5 <= 0.05 as jaccard_ge_0_5_pass, identity_rate <= 0.02 as identity_rate_pass,
    number_preservation >= 0.95 as number_preservation_pass, length_collapse_rate <= 0.10 as length_collapse_rate_pass, good_neutral_rate >= 0.70 as good_neutral_rate_pass,
    coalesce(jaccard_ge_0_5 <= 0.05, false) and coalesce(identity_rate <= 0.02, false) and coalesce(number_preservation >= 0.95, false) and coalesce(length_collapse_rate <= 0.10, false)
      and coalesce(good_neutral_rate >= 0.70, false) as quality_gate_passed from s"""
)
def quality_gate(spark, sf_dir):
    g = E.quality_gate(E.summarize_quality(validated(spark, sf_dir, ngrams=False), "failed", ["style_type"]))
    return g.select("style_type", *[f"{m}_pass" for m in E.QUALITY_TARGETS], "quality_gate_passed")


@query(
    f"""with {_cascade(False)} select style_type, count(post_id) as n, round(avg(cast(failed as int)), 4) as failed, round(avg(cast(jaccard >= 0.5 as int)), 4) as share_ge_0_5,
    round(avg(cast(jaccard < 0.3 as int)), 4) as share_lt_0_3 from validated group by 1"""
)
def quality_by_type(spark, sf_dir):
    return E.report_by_type(validated(spark, sf_dir, ngrams=False))


@query(
    f"""with {_cascade(False)} select post_id, jaccard >= 0.3 and jaccard < 0.45 and jaccard is not null as borderline from validated where not failed"""
)
def borderline_pairs(spark, sf_dir):
    return validated(spark, sf_dir, ngrams=False).where("not failed").select("post_id", overlap.is_borderline(F.col("jaccard")).alias("borderline"))


_STRATA = f"""records as (select doc_id as post_id, lang as style_type, text as response_clean, length(text) as char_len, len(regexp_extract_all(text, chr(10) || chr(10))) + 1 as n_paragraphs,
  regexp_matches(text, '[\\x{{1F600}}-\\x{{1FAFF}}]') as has_emoji, {sql.text_hash('text')} as group_id, doc_id as date from documents),
edges as (select style_type, quantile_cont(char_len, 0.25) as e1, quantile_cont(char_len, 0.5) as e2, quantile_cont(char_len, 0.75) as e3 from records group by 1),
cols as (select r.*, regexp_matches(response_clean, '[0-9]') as has_numbers, case when char_len <= e1 then 'Q1' when char_len <= e2 then 'Q2' when char_len <= e3 then 'Q3' else 'Q4' end as char_len_q,
  n_paragraphs >= 2 as multi_para from records r join edges using (style_type)),
strata as (select *, char_len_q || '_' || case when multi_para then 'True' else 'False' end || '_' || case when has_numbers then 'True' else 'False' end || '_' || case when has_emoji then 'True' else 'False' end as stratum from cols)"""
_QUOTA = f"""{_STRATA}, shares as (select style_type, stratum, count(*) as size, count(*) / sum(count(*)) over (partition by style_type) as share from strata group by 1, 2),
quota as (select s.*, md5('42:' || post_id) as k, size, row_number() over (partition by s.style_type, s.stratum order by md5('42:' || post_id), post_id) as r, greatest(1, cast(round_even(share * 20, 0) as int)) as q
  from strata s join shares h on s.style_type = h.style_type and s.stratum = h.stratum)"""


def strata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = T.features(d.select(F.col("doc_id").alias("post_id"), F.col("doc_id").alias("date"), F.col("lang").alias("style_type"), F.col("text").alias("response_clean")), "response_clean")
    return S.add_strata(rows, ["style_type"])


@query(f"with {_STRATA} select post_id, char_len_q, multi_para, has_numbers, stratum from strata")
def length_quartiles(spark, sf_dir):
    return strata(spark, sf_dir).select("post_id", "char_len_q", "multi_para", "has_numbers", "stratum")


@query(f"with {_STRATA} select style_type, stratum, count(*) as n, round(count(*) / sum(count(*)) over (partition by style_type), 6) as share from strata group by 1, 2")
def stratum_proportions(spark, sf_dir):
    return S.proportions(strata(spark, sf_dir), ["style_type"]).withColumn("share", F.round("share", 6))


@query(f"with {_QUOTA} select style_type, post_id, stratum from quota qualify row_number() over (partition by style_type order by case when r <= q then 0 else 1 end, k, post_id) <= 20")
def stratified_sample(spark, sf_dir):
    return S.stratified_sample(strata(spark, sf_dir), 20, by=["style_type"]).select("style_type", "post_id", "stratum")


@query(f"with {_QUOTA} select style_type, post_id, stratum from (select * from quota where r <= q) qualify row_number() over (partition by style_type order by size desc, stratum, k, post_id) <= 20")
def stratified_sample_no_topup(spark, sf_dir):
    return S.stratified_sample_no_topup(strata(spark, sf_dir), 20, by=["style_type"]).select("style_type", "post_id", "stratum")


@query(
    f"""with {_QUOTA} select style_type || ':' || post_id as pilot_id, post_id, group_id, style_type, 'val' as split, 'val' as source_split, style_type || '_val.jsonl' as source_file, date, char_len, n_paragraphs, has_emoji, has_numbers,
    char_len_q, multi_para, stratum, 42 as manifest_seed from quota qualify row_number() over (partition by style_type order by case when r <= q then 0 else 1 end, k, post_id) <= 20"""
)
def pilot_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = T.features(d.select(F.col("doc_id").alias("post_id"), F.col("doc_id").alias("date"), F.col("lang").alias("style_type"), F.col("text").alias("response_clean"), F.lit("val").alias("split")), "response_clean")
    return S.pilot_manifest(rows, 20).drop("response_clean", "manifest_created_at")


def override_records(spark, sf_dir):
    """labels as override records: quality tells success, toxic rows have no text, ids give the overlap."""
    lab, doc = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return lab.join(doc.select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").alias("post_id"), F.col("lang").alias("style_type"), F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("Topic: "), F.col("doc_id").cast("string"))).alias("neutral"),
        F.lit(None).cast("string").alias("synthetic_input"), F.lit("").alias("input"), (F.col("quality") == 0).alias("failed"), F.lit(None).cast("boolean").alias("synthetic_ok"),
        F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 10) / 10).alias("jaccard"), F.when(F.col("doc_id") % 2 == 0, "brief_v4").alias("prompt_mode"), F.col("doc_id").alias("pos"),
    )


_OVERRIDES = """o as (select l.doc_id as post_id, d.lang as style_type, case when toxic = 1 then '' else 'Topic: ' || l.doc_id end as txt, quality = 0 as failed,
case when l.doc_id % 7 <> 0 then (l.doc_id % 10) / 10 end as jaccard, case when l.doc_id % 2 = 0 then 'llm_brief_v4' else 'llm_synthetic' end as src from labels l join documents d on l.doc_id = d.doc_id),
classified as (select *, case when failed then 'rejected_failed' when txt = '' then 'rejected_missing_input' when coalesce(jaccard >= 0.3, true) then 'rejected_jaccard' else 'accepted' end as status from o)"""


@query(
    f"""with {_OVERRIDES} select count(*) as loaded, count(*) filter (where status = 'accepted') as accepted, count(*) filter (where status = 'rejected_failed') as rejected_failed,
    count(*) filter (where status = 'rejected_missing_input') as rejected_missing_input, count(*) filter (where status = 'rejected_jaccard') as rejected_jaccard from classified"""
)
def override_stats(spark, sf_dir):
    return P.override_stats(P.classify_overrides(override_records(spark, sf_dir), 0.3))


@query(
    f"""with {_OVERRIDES} select d.doc_id, md5(coalesce(c.txt, {sql.heuristic_brief('d.text')})) as input, coalesce(c.src, 'heuristic') as input_source
    from documents d left join (select * from classified where status = 'accepted') c on c.post_id = d.doc_id and c.style_type = d.lang"""
)
def override_join(spark, sf_dir):
    o = P.accepted_overrides(P.classify_overrides(override_records(spark, sf_dir), 0.3), "pos")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("style_type"), F.col("doc_id").alias("post_id"), T.heuristic_brief(F.col("text")).alias("h"))
    return d.join(o, ["style_type", "post_id"], "left").select("doc_id", F.md5(F.coalesce("override_input", "h")).alias("input"), F.coalesce("override_source", F.lit("heuristic")).alias("input_source"))


@query(
    f"""with {_SPLIT}, {_OVERRIDES.replace('classified as', 'cls as')}, j as (select s.split, c.src is not null as hit from split s left join (select * from cls where status = 'accepted') c on c.post_id = s.post_id and c.style_type = s.style_type)
    select split, count(*) filter (where hit) as overrides, count(*) as n from j group by rollup (split)"""
)
def override_counts(spark, sf_dir):
    from .pipelines import override_counts as counts

    o = P.accepted_overrides(P.classify_overrides(override_records(spark, sf_dir), 0.3), "pos")
    return counts(splits(spark, sf_dir).join(o, ["style_type", "post_id"], "left").withColumn("input_source", F.coalesce("override_source", F.lit("heuristic"))))


def _prompt(style: str, text: str) -> str:
    return f"'Below is an instruction that describes a task, paired with an input that provides further context.' || chr(10) || 'Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || 'Rewrite the input into a Telegram post in style type ' || {style} || '. Preserve the facts, but match the tone, structure, pacing, and ending typical for this style.' || chr(10) || chr(10) || '### Input:' || chr(10) || {text} || chr(10) || chr(10) || '### Response:' || chr(10)"



@query(
    f"""with {_SPLIT}, r as (select *, {sql.clean('text')} as body from split), b as (select *, {sql.heuristic_brief('body')} as inp from r)
    select post_id, split, style_type, md5(inp) as input, md5(body) as response_clean, md5({_prompt('style_type', 'inp')} || body) as prompt from b"""
)
def processed_records(spark, sf_dir):
    r = P.build_records(T.features(splits(spark, sf_dir)))
    return r.select("post_id", "split", "style_type", F.md5("input").alias("input"), F.md5("response_clean").alias("response_clean"), F.md5("prompt").alias("prompt"))


@query("select doc_id from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def pending_anti_join(spark, sf_dir):
    return C.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("select doc_id, quality, toxic, pos from (select doc_id, n_chars as pos from documents) join labels using (doc_id)")
def ordered_reassembly(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("pos"))
    return C.reassemble(d, table(spark, sf_dir, "labels"), ["doc_id"], "pos").select("doc_id", "quality", "toxic", "pos")


@query("select count(*) as n_ok from documents where doc_id in (select doc_id from labels where quality = 1)")
def ok_count_semi(spark, sf_dir):
    ok = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").join(ok, "doc_id", "left_semi").agg(F.count("*").alias("n_ok"))


@query("select doc_id, case when doc_id % 3 = 0 then 1 - quality else quality end as quality, toxic from labels")
def cache_merge_last_wins(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return C.upsert(lab, lab.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality")), ["doc_id"])


@query("select doc_id, case when quality = 1 then 'openrouter_synthetic' else 'heuristic' end as input_source from labels")
def cache_relabel(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("synthetic_ok"), F.lit("heuristic").alias("input_source"))
    return C.relabel(lab, "openrouter").select("doc_id", "input_source")


@query(
    """with j as (select d.doc_id, d.lang, coalesce(l.quality, 0) as ok from documents d left join labels l on l.doc_id = d.doc_id),
    r as (select *, row_number() over (partition by lang order by doc_id desc) as n, sum(ok) over (partition by lang order by doc_id desc rows unbounded preceding) as s from j),
    c as (select *, cast((n - 1) // 10 as int) as chunk from r), t as (select *, min(case when s >= 15 then chunk end) over (partition by lang) as stop from c)
    select doc_id, lang, chunk from t where stop is null or chunk <= stop"""
)
def target_ok_cutoff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(0)).alias("ok"))
    return C.until_target(d, F.col("ok") == 1, [F.col("doc_id").desc()], 15, 10, ["lang"]).select("doc_id", "lang", "chunk")


def attempt_logs(spark, sf_dir):
    """events as attempts of one request a user and type: small values failed."""
    e = table(spark, sf_dir, "events")
    model = F.when(F.col("event_id") % 3 == 0, "openai/gpt-4.1").otherwise("openai/gpt-4.1-mini")
    p, c = F.floor("value").cast("long"), F.lit(32).cast("long")
    a = F.struct(
        F.col("event_id"), model.alias("model"), (F.col("value") < 50).alias("failed"), p.alias("usage_prompt_tokens"), c.alias("usage_completion_tokens"), (p + c).alias("usage_total_tokens"),
        cost.cost_usd(p, c, model).alias("cost_usd_estimate"),
    )
    return e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(a)).alias("attempts"))


_EVENTS = """a as (select *, case when event_id % 3 = 0 then 'openai/gpt-4.1' else 'openai/gpt-4.1-mini' end as model, value < 50 as failed, cast(floor(value) as bigint) as p from events)"""


@query(
    f"""with {_EVENTS}, r as (select *, row_number() over (partition by user_id, event_type order by case when failed then 1 else 0 end, case when failed then -event_id else event_id end) as r from a)
    select user_id, event_type, event_id, failed from r where r = 1"""
)
def best_attempt(spark, sf_dir):
    b = attempt_logs(spark, sf_dir).select("user_id", "event_type", C.best_attempt(F.col("attempts")).alias("b"))
    return b.select("user_id", "event_type", "b.event_id", "b.failed")


_COST = "round(p / 1000000 * case model when 'openai/gpt-4.1' then 2.0 else 0.4 end + 32 / 1000000 * case model when 'openai/gpt-4.1' then 8.0 else 1.6 end, 6)"


@query(
    f"""with {_EVENTS} select user_id, event_type, cast(sum(p) as bigint) as usage_prompt_tokens, cast(sum(32) as bigint) as usage_completion_tokens, cast(sum(p + 32) as bigint) as usage_total_tokens,
    round(sum({_COST}), 6) as cost_usd_estimate, count(*) as attempts, bool_or(model <> 'openai/gpt-4.1-mini') as used_fallback from a group by 1, 2"""
)
def attempt_rollup(spark, sf_dir):
    r = attempt_logs(spark, sf_dir).select("user_id", "event_type", C.rollup_attempts(F.col("attempts"), "openai/gpt-4.1-mini").alias("r")).select("user_id", "event_type", "r.*")
    return r.withColumn("attempts", F.col("attempts").cast("long"))


_USAGE = f"cast(150 + ceil(length({sql.strip('text')}) / 1.7::double) as bigint) as p, cast(greatest(32, ceil(length({sql.strip('text')}) * 0.9::double / 1.7::double)) as bigint) as c"


@query(f"select doc_id, p as prompt_tokens, c as completion_tokens, p + c as total_tokens from (select doc_id, {_USAGE} from documents)")
def usage_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cost.estimate_usage(F.col("text")).alias("u")).select("doc_id", "u.*")


@query(
    f"""with u as (select {_USAGE} from documents), m as (select * from (values ('google/gemini-2.5-flash-lite', 0.10, 0.40), ('openai/gpt-4.1-mini', 0.40, 1.60), ('google/gemini-2.5-flash', 0.30, 2.50),
    ('anthropic/claude-haiku-4.5', 1.00, 5.00), ('openai/gpt-4.1', 2.00, 8.00), ('unknown', null, null)) t(model, i, o))
    select model, round(sum(round(p / 1000000 * cast(i as double) + c / 1000000 * cast(o as double), 6)), 4) as cost from u cross join m group by 1"""
)
def cost_by_model(spark, sf_dir):
    models = F.explode(F.array(*[F.lit(m) for m in [*cost.PRICES, "unknown"]])).alias("model")
    u = table(spark, sf_dir, "documents").select(cost.estimate_usage(F.col("text")).alias("u")).select("u.*").select("prompt_tokens", "completion_tokens", models)
    return u.groupBy("model").agg(F.round(F.sum(cost.cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("model"))), 4).alias("cost"))


@query(
    f"""with u as (select lang as path, {_USAGE} from documents)
    select coalesce(path, 'TOTAL') as path, cast(sum(p) as bigint) as usage_prompt_tokens, cast(sum(c) as bigint) as usage_completion_tokens, cast(sum(p + c) as bigint) as usage_total_tokens, count(*) as usage_estimated_records,
    round(sum(round(p / 1000000 * 0.4::double + c / 1000000 * 1.6::double, 6)), 4) as cost_usd_estimate from u group by rollup (path)"""
)
def cost_total_rollup(spark, sf_dir):
    from .pipelines import cost_table

    d = table(spark, sf_dir, "documents")
    out = cost_table(d.select(F.col("lang").alias("path"), F.col("text").alias("response_clean")), "openai/gpt-4.1-mini")
    return out.drop("n_records").withColumn("cost_usd_estimate", F.round("cost_usd_estimate", 4))


_PAYLOAD = """case event_id % 4 when 0 then '```json' || chr(10) || '{"topic": " T' || event_id || '", "facts": ["a ", "", "' || event_type || '"]}' || chr(10) || '```' when 1 then '{"topic": "x", "facts": "no list"}'
when 2 then 'not json' else '' end"""


@query(
    """select event_id, case event_id % 4 when 0 then 'Topic: T' || event_id || chr(10) || 'Facts:' || chr(10) || '- a' || chr(10) || '- ' || event_type when 3 then '' end as parsed,
    case event_id % 4 when 1 then 'invalid_facts' when 2 then 'invalid_json' end as parse_error from events"""
)
def json_payload_parse(spark, sf_dir):
    k = F.col("event_id") % 4
    good = F.concat(F.lit('```json\n{"topic": " T'), F.col("event_id").cast("string"), F.lit('", "facts": ["a ", "", "'), "event_type", F.lit('"]}\n```'))
    content = F.when(k == 0, good).when(k == 1, '{"topic": "x", "facts": "no list"}').when(k == 2, "not json").otherwise("")
    return payload.parse(table(spark, sf_dir, "events").withColumn("content", content), "content", "brief_v4").select("event_id", "parsed", "parse_error")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"select conv_id, turn, md5({_prompt('role', 'text')}) as prompt from conversations")
def prompt_format(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(prompts.inference_prompt(F.col("role"), F.col("text"))).alias("prompt"))


@query(f"select conv_id, turn, case when turn % 2 = 0 then {sql.strip('text')} else {sql.strip(sql.strip('text'))} end as response from conversations")
def extract_response(spark, sf_dir):
    full = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("p ### Response: x ### Response: "), "text", F.lit("</s>"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.extract_response(full).alias("response"))


_LEN = f"length({sql.strip('text')}) as c, {sql.blank_words('text')} as w"


@query(
    f"""with r as (select role, {_LEN} from conversations) select role, count(*) as n, round(avg(c), 1) as char_mean, round(median(c), 1) as char_median, round(stddev_samp(c), 1) as char_std, min(c) as char_min, max(c) as char_max,
    round(avg(w), 1) as word_mean, round(median(w), 1) as word_median from r group by 1"""
)
def length_stats(spark, sf_dir):
    return E.length_stats(table(spark, sf_dir, "conversations"), "text", ["role"])


def turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"])


@query(
    f"""with t as (select u.conv_id, u.turn, length({sql.strip('u.text')}) as ic, {sql.blank_words('u.text')} as iw, length({sql.strip('a.text')}) as rc, {sql.blank_words('a.text')} as rw
    from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 and u.role = 'user' and a.role = 'assistant')
    select conv_id, turn, ic as input_chars, iw as input_words, rc as ref_chars, rw as ref_words, round(rc / greatest(ic, 1), 3) as ref_input_char_ratio from t"""
)
def length_compare(spark, sf_dir):
    return E.length_compare(turns(spark, sf_dir), "input", "response").drop("input", "response")


@query(
    f"""with d as (select lang, length({sql.strip('text')}) as c, length({sql.strip(sql.heuristic_brief('text'))}) as b from documents)
    select lang as style_type, count(*) as n, round(avg(c / greatest(b, 1)), 3) as ratio_mean, round(median(round(c / greatest(b, 1), 3)), 3) as ratio_median from d group by 1"""
)
def length_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("style_type"), T.heuristic_brief(F.col("text")).alias("input"), "text")
    r = E.length_compare(d, "input", "text").withColumn("raw", F.col("ref_chars") / F.greatest("input_chars", F.lit(1)))
    s = summaries(r, {"raw": ("raw", [0.5]), "ratio": ("ref_input_char_ratio", [0.5])}, ["style_type"])
    return s.select("style_type", F.col("rows").alias("n"), F.round("raw.mean", 3).alias("ratio_mean"), F.round(F.col("ratio.q")[0], 3).alias("ratio_median"))


@query(
    """with p as (select a.vec_id, list_transform(a.embedding, lambda x: cast(x as double)) as a, list_transform(b.embedding, lambda x: cast(x as double)) as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select vec_id, round(list_cosine_similarity(a, b), 6) as cosine from p"""
)
def cosine_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(E.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(
    """with p as (select list_cosine_similarity(list_transform(a.embedding, lambda x: cast(x as double)), list_transform(b.embedding, lambda x: cast(x as double))) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select round(avg(c), 6) as mean, round(median(c), 6) as median, round(stddev_pop(c), 6) as std, round(min(c), 6) as min, round(max(c), 6) as max, count(c) as n from p"""
)
def cosine_summary(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select(E.cosine(F.col("embedding"), F.col("other")).alias("cosine"))
    return E.cosine_summary(p)


_PRED = "p as (select l.quality as actual, case when d.n_chars >= 1000 then 1 else 0 end as predicted, (d.n_chars % 100) / 100 as prob from labels l join documents d on l.doc_id = d.doc_id)"


def predicted(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").alias("actual"), F.when(n >= 1000, 1).otherwise(0).alias("predicted"), ((n % 100) / 100).alias("prob"))


@query(f"with {_PRED} select actual, count(*) as n, round(count(*) filter (where predicted = 0) / count(*), 4) as to_0, round(count(*) filter (where predicted = 1) / count(*), 4) as to_1 from p group by 1")
def confusion_matrix(spark, sf_dir):
    return E.confusion(predicted(spark, sf_dir), "actual", "predicted", [0, 1])


@query(f"with {_PRED} select round(avg(cast(actual = predicted as int)), 4) as style_accuracy, round(avg(prob), 4) as style_confidence, count(*) as n from p")
def style_scores(spark, sf_dir):
    return E.class_scores(predicted(spark, sf_dir), "actual", "predicted", "prob")


@query()
def style_classifier(spark, sf_dir):
    half = F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", half.alias("half"))
    classes = sorted(r["lang"] for r in d.where("lang is not null").select("lang").distinct().collect())
    # every row is predicted, by the model of the other half
    parts = [E.StyleClassifier(classes).fit(d.where(f"half <> {k} and lang is not null"), "text", "lang").predict(d.where(f"half = {k}"), "text") for k in (0, 1)]
    return E.confusion(parts[0].unionByName(parts[1]), "lang", "predicted", classes)


@query()
def mauve_score(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    m = E.mauve(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"))
    return spark.createDataFrame([tuple(m[c] for c in ("mauve", "frontier_integral", "n_generated", "n_reference"))], "mauve double, frontier_integral double, n_generated long, n_reference long")


@query(
    """select doc_id, case when doc_id % 100 = 7 then 1 - quality when doc_id % 100 = 8 then 2 else quality end as quality, case when doc_id % 100 = 7 then 'third' when doc_id % 100 = 8 then 'second' else 'first' end as source from labels
    union all select doc_id + 10000000, 5, 'second' from labels where doc_id % 100 = 8"""
)
def growing_cache(spark, sf_dir):
    """Labels as a cache by key: one load, then two upserts of a hundredth of the keys each, the first with new keys too."""
    d = table(spark, sf_dir, "labels").select("doc_id", "quality")
    cache = keyed_cache.KeyedCache(spark, files.scratch(spark, "cache"), ["doc_id"], buckets=16)
    cache.upsert(d.withColumn("source", F.lit("first")))
    some = d.where("doc_id % 100 = 8")
    second = some.withColumn("quality", F.lit(2)).unionByName(some.select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit(5).alias("quality")))
    cache.upsert(second.withColumn("source", F.lit("second")))
    cache.upsert(d.where("doc_id % 100 = 7").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit("third").alias("source")))
    return cache.load().select("doc_id", "quality", "source")


@query(
    """with v as (select vec_id % 2 as side, array_to_string(list_transform(range(1, 5), lambda i: case when embedding[i] > 0 then '1' else '0' end), '') as bin from embeddings where embedding is not null),
    h as (select bin, count(*) filter (where side = 0) as n0, count(*) filter (where side = 1) as n1 from v group by bin), pq as (select n0 / sum(n0) over () as p, n1 / sum(n1) over () as q from h),
    w as (select 1e-6 + i * (1 - 2e-6) / 24 as w from (select unnest(range(0, 25)) as i)),
    c as (
      select exp(-5 * sum(case when q > 0 then q * ln(q / (w * p + (1 - w) * q)) else 0 end)) as y, exp(-5 * sum(case when p > 0 then p * ln(p / (w * p + (1 - w) * q)) else 0 end)) as x from pq, w group by w
      union all select 0.0, 1.0 union all select 1.0, 0.0
    ), area as (
      select sum((x - x0) * (y + y0) / 2) as a from (select x, y, lag(x) over (order by x, y desc) as x0, lag(y) over (order by x, y desc) as y0 from c)
      union all select sum((y - y0) * (x + x0) / 2) as a from (select x, y, lag(x) over (order by y, x desc) as x0, lag(y) over (order by y, x desc) as y0 from c)
    ), f as (select sum(case when abs(p - q) <= 1e-12 then 0 when p = 0 or q = 0 then (p + q) / 2 else (p + q) / 2 - p * q * ln(p / q) / (p - q) end) as fi from pq)
    select round(avg(a), 6) as mauve, round((select fi from f), 6) as frontier_integral from area"""
)
def divergence_of_signs(spark, sf_dir):
    """Both figures of MAUVE for vectors binned by the signs of their first four components."""
    signs = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(F.element_at("embedding", i) > 0, "1").otherwise("0")), "")
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select((F.col("vec_id") % 2).alias("side"), signs.alias("bin"))
    d = E.divergence(rows)
    return spark.createDataFrame([(round(d["mauve"], 6), round(d["frontier_integral"], 6))], "mauve double, frontier_integral double")


@query()
def memorization_nearest(spark, sf_dir):
    return N.nearest_texts(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query(
    f"""with {sql.shingle_ctes('q', 'benchmark', 'item_id', 'text')}, {sql.shingle_ctes('c', 'documents', 'doc_id', 'text')},
    qn as (select item_id, count(*) as qn from q group by 1), cn as (select doc_id, count(*) as cn from c group by 1), p as (select item_id, doc_id, count(*) as n_shared from q join c on q.g = c.g group by 1, 2),
    s as (select p.*, round(n_shared / (qn + cn - n_shared), 6) as j from p join qn on qn.item_id = p.item_id join cn on cn.doc_id = p.doc_id)
    select item_id as query_id, doc_id as nearest_id, j as jaccard_5gram, n_shared from s qualify row_number() over (partition by item_id order by j desc, doc_id) = 1"""
)
def memorization_5gram(spark, sf_dir):
    return N.nearest_by_shingles(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query()
def memorization_summary(spark, sf_dir):
    return E.memorisation_summary(memorization_nearest(spark, sf_dir))


@query()
def top5_nearest(spark, sf_dir):
    return memorization_nearest(spark, sf_dir).orderBy(F.desc("fuzz_ratio"), "query_id").limit(5)


@query("select lang as style_type, doc_id, 'a' as part from documents where lang = 'en' union all select lang, doc_id, 'b' from documents where lang <> 'en'")
def union_types(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("style_type"), "doc_id")
    return d.where("style_type = 'en'").withColumn("part", F.lit("a")).unionByName(d.where("style_type <> 'en'").withColumn("part", F.lit("b")))


@query("select distinct lang, source from documents")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query(
    """with t as (select cast(ceil(length(text) / 1.7::double) as bigint) as n from documents)
    select count(*) filter (where n > 1024) as dropped, max(n) as max_tokens, quantile_disc(n, 0.95) as p95 from t"""
)
def max_token_stats(spark, sf_dir):
    return P.max_token_filter(table(spark, sf_dir, "documents"), 1024, F.ceil(F.length("text").cast("double") / 1.7))[1]


@query("select conv_id, turn from conversations where turn < 2")
def prefix_limit(spark, sf_dir):
    return P.prefix_limit(table(spark, sf_dir, "conversations"), 2, "turn").select("conv_id", "turn")


@query(
    """with b as (select source, avg(n_chars) as v from documents where doc_id % 2 = 0 group by 1), t as (select source, avg(n_chars) as v from documents where doc_id % 3 = 0 group by 1)
    select source, round(b.v, 4) as score_base, round(t.v, 4) as score_tuned, round(round(t.v, 4) - round(b.v, 4), 4) as score_delta from b full join t using (source)"""
)
def baseline_vs_tuned(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    part = lambda k: d.where(f"doc_id % {k} = 0").groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("score"))
    return E.side_by_side(part(2), part(3), "source", ["score"])


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as rank, count(*) over (partition by l_returnflag) as total from lineitem")
def distributed_ranks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return P.ranks(li, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"), "total")


# Exports, synthetic records, prompts and answers.


@query(
    """select conv_id as post_id, turn, 'conv' || conv_id as channel, case when turn % 3 = 0 then timestamp '2024-01-01 10:00:00' + to_seconds(turn) end as date,
    md5(case turn % 4 when 0 then text when 1 then 'a ' || text || ' c' when 2 then '' else '[' || text end) as text from conversations where role <> 'system'"""
)
def export_messages(spark, sf_dir):
    """Conversations as message exports (strings, lists of parts, no text; bad dates; service messages), parsed again."""
    own = F.to_json(F.struct("text"))  # {"text":"..."}
    quoted = F.substr(own, F.lit(9), F.length(own) - 9)
    k = F.col("turn") % 4
    text = F.when(k == 0, quoted).when(k == 1, F.concat(F.lit('["a ",'), own, F.lit(',{"type":"x"}," c"]'))).when(k == 2, F.lit('null')).otherwise(F.concat(F.lit('"['), F.substr(quoted, F.lit(2))))
    date = F.when(F.col("turn") % 3 == 0, F.date_format(F.timestamp_seconds(F.lit(1704103200) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss")).otherwise("no date")
    kind = F.when(F.col("role") == "system", "service").otherwise("message")
    message = F.concat(F.lit('{"id":'), F.col("conv_id") * 100 + F.col("turn"), F.lit(',"type":"'), kind, F.lit('","date":"'), date, F.lit('"'), F.when(k == 2, "").otherwise(F.concat(F.lit(',"text":'), text)), F.lit("}"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat_ws(",", F.collect_list(message)).alias("m"))
    docs = docs.select(F.concat(F.lit('{"name":"conv'), F.col("conv_id"), F.lit('","messages":['), "m", F.lit("]}")).alias("value"), F.lit("/x/y.json").alias("file"))
    m = readers.parse_export(docs)
    return m.select(F.floor(F.col("post_id") / 100).cast("long").alias("post_id"), F.pmod("post_id", F.lit(100)).cast("int").alias("turn"), "channel", "date", F.md5("text").alias("text"))


@query(
    """select doc_id as post_id, 'export ' || doc_id // 2500 as channel, timestamp '2024-01-01 00:00:00' + to_seconds(cast(doc_id as bigint)) as date, md5(coalesce(text, '') || ' {"}') as text
    from documents where lang is distinct from 'de'"""
)
def split_exports(spark, sf_dir):
    """Documents as JSON exports of 2,500 messages, each file one object in one line, read in splits; rows of one language are service messages."""
    d = table(spark, sf_dir, "documents").withColumn("file", F.floor(F.col("doc_id") / 2500))
    kind = F.when(F.col("lang").eqNullSafe("de"), "service").otherwise("message")
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(' {"}'))
    message = F.to_json(F.struct(F.col("doc_id").alias("id"), kind.alias("type"), date.alias("date"), F.array(F.struct(F.lit("bold").alias("type"), text.alias("text"))).alias("text")))
    own = d.select("file", F.lit(1).alias("o"), F.concat(F.lit(","), message).alias("value"))
    ends = d.select("file").distinct().select("file", F.inline(F.array(
        F.struct(F.lit(0).alias("o"), F.concat(F.lit('{"name":"export '), "file", F.lit('","messages":[{"type":"first"}')).alias("value")), F.struct(F.lit(2).alias("o"), F.lit("]}").alias("value")),
    )))
    path = files.scratch(spark, "exports")
    both = own.unionByName(ends).repartition("file").sortWithinPartitions("file", "o")
    both.select("file", "value").write.partitionBy("file").option("lineSep", " ").text(path)
    m = readers.read_export(spark, path)
    return m.select("post_id", "channel", "date", F.md5("text").alias("text"))


@query(
    f"""with {_PAIRS}, t as (select *, not {sql.numbers_preserved('response_clean', 'candidate')} as lost, {sql.jaccard('response_clean', 'candidate')} as j from pairs), f as (select *, candidate = '' or lost as failed from t)
    select post_id, md5(case when failed then '' else candidate end) as synthetic_input, not failed as synthetic_ok, case when failed then 'heuristic' else 'openrouter_synthetic' end as input_source,
    case when candidate = '' then 'empty_after_clean' when lost then 'numbers_not_preserved' end as failure_reason, case when not failed then round(j, 4) end as jaccard,
    not failed and {sql.strip('candidate')} = {sql.strip('response_clean')} as is_identity, not failed as numbers_preserved,
    case when not failed then round(length(candidate) / greatest(length(response_clean), 1), 4) end as length_ratio, case when not failed then {sql.jaccard_bin('j')} end as jaccard_bin from f"""
)
def enrich_records(spark, sf_dir):
    rows = rewritten(spark, sf_dir).withColumns({"input": F.lit("x"), "input_source": F.lit("heuristic")})
    out = P.enrich(rows, "candidate", "openrouter", "m", F.lit("2024-01-01T00:00:00Z"))
    return out.select(
        "post_id", F.md5("synthetic_input").alias("synthetic_input"), "synthetic_ok", "input_source", "failure_reason", "jaccard", "is_identity", "numbers_preserved", "length_ratio", "quality_flags.jaccard_bin"
    )


@query("select conv_id, turn, md5(coalesce(case when turn % 2 = 0 then text end, case when turn % 3 = 0 then role end, '')) as said from conversations")
def response_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumns({"response_clean": F.when(F.col("turn") % 2 == 0, F.col("text")), "response": F.when(F.col("turn") % 3 == 0, F.col("role"))})
    return c.select("conv_id", "turn", F.md5(P.response_text(c)).alias("said"))


@query("select lang, source, doc_id, n_chars from documents qualify row_number() over (partition by lang, source order by n_chars, doc_id) = 1")
def first_of_each_key(spark, sf_dir):
    return C.first_wins(table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], ["n_chars", "doc_id"])


def _rank(why: str, position: int) -> str:
    said = f"({why} is null or {why} not in ('numbers_not_preserved', 'identity'))"
    return (
        f"{{'a': {why} is not null, 'b': case when {why} is null then coalesce(nullif(round(jr, 4), 0.0), 1.0) else 1.0 end, 'c': case when {said} then coalesce(nullif(round(r, 4), 0.0), 1.0) else 1.0 end, "
        f"'d': case when {said} then n else 0 end, 'e': {position}}}"
    )


@query(
    f"""with {_cascade(False)}, both_ as (select post_id, jr, n, r, why as base, case when why is not null then why when n >= 5 then 'copied_span' when r >= 0.25 then 'copied_4gram_ratio' end as strict from w)
    select post_id, (base is null and round(jr, 4) >= 0.3 and round(jr, 4) < 0.45) or coalesce(strict in ('copied_span', 'copied_4gram_ratio'), false) as postedit,
    case when {_rank('base', 1)} < {_rank('strict', 0)} then base else strict end as better from both_"""
)
def postedit_choice(spark, sf_dir):
    v = overlap.with_validation(overlap.with_validation(rewritten(spark, sf_dir), "response_clean", "candidate", to="base"), "response_clean", "candidate", to="strict", **overlap.STRICT)
    return v.select("post_id", overlap.should_postedit(F.col("base"), F.col("strict")).alias("postedit"), overlap.better_validation(F.col("strict"), F.col("base"))["failure_reason"].alias("better"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(" union all ".join(f"select item_id, '{m}' as mode, md5(replace({_sql_text(t.replace('{fact_limit}', '4'))}, '{{text}}', text)) as prompt from benchmark" for m, t in prompts.USER_TEMPLATES.items()))
def user_prompts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    each = [b.select("item_id", F.lit(m).alias("mode"), F.md5(prompts.user_prompt(F.col("text"), m, 4)).alias("prompt")) for m in prompts.modes()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


_FACTS = f"list_filter(list_transform({sql.sentences('text')}[2:5], lambda f: {sql.strip('f')}), lambda f: f <> '')"
_NUMS = f"list_sort({sql.numbers('text')})"


@query(
    f"""with d as (select doc_id, coalesce({sql.sentences('text')}[1], '') as topic, {_NUMS} as nums, {_FACTS} as facts, lang, source from documents)
    select doc_id, md5(array_to_string(list_filter([case when topic <> '' then 'Topic: ' || topic end, 'Entities:' || chr(10) || '- ' || lang || chr(10) || '- ' || source,
      case when len(nums) > 0 then 'Numbers:' || chr(10) || array_to_string(list_transform(nums, lambda x: '- ' || x), chr(10)) end,
      case when len(facts) > 0 then 'Facts:' || chr(10) || array_to_string(list_transform(facts, lambda x: '- ' || x), chr(10)) end], lambda x: x is not null), chr(10))) as brief from d"""
)
def answers_of_documents(spark, sf_dir):
    """Documents as fenced JSON answers of four fields, with blanks and empty entries, parsed into briefs."""
    s = T.sentences(F.col("text"))
    facts = F.transform(F.slice(s, F.lit(2), F.lit(4)), lambda f: F.concat(F.lit("  "), f, F.lit(" ")))
    answer = F.struct(
        F.coalesce(F.try_element_at(s, F.lit(1)), F.lit("")).alias("topic"), F.array("lang", F.lit(" "), F.concat(F.lit(" "), "source")).alias("entities"),
        F.array_sort(T.numbers(F.col("text"))).alias("numbers"), F.concat(facts, F.array(F.lit(""))).alias("facts"),
    )
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("```json\n"), F.to_json(answer), F.lit("\n```")).alias("content"))
    return payload.parse(d, "content", "brief_v3").select("doc_id", F.md5("parsed").alias("brief"))


@query("select event_id, case when event_id % 3 = 2 then event_id else cast(floor(value) as bigint) + 32 end as total from events")
def usage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    given = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 2, F.col("event_id")).cast("long")
    return e.select("event_id", cost.usage_total(F.floor("value").cast("long"), F.lit(32).cast("long"), given).alias("total"))


@query("select item_id as pos, md5(text || '|' || substr(text, 1, 5)) as both_texts from benchmark")
def zipped_by_position(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")
    z = E.zip_by_position(b, b.select("pos", F.substring("text", 1, 5).alias("generated")))
    return z.select("pos", F.md5(F.concat("text", F.lit("|"), "generated")).alias("both_texts"))


@query("select doc_id, 'openrouter_synthetic' as input_source from labels where quality = 1")
def records_of_source(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("synthetic_ok"), F.lit("heuristic").alias("input_source"))
    return P.filter_by_source(P.usable(C.relabel(lab, "openrouter")), "openrouter_synthetic").select("doc_id", "input_source")


def _echo(model: str, system: str, prompt: str) -> dict:
    """A text backend that only changes an article; the primary model fails on every seventh length, and lengths that divide by 11 are refused."""
    import json

    text = prompt.split("<source_text>\n", 1)[1].rsplit("\n</source_text>", 1)[0]
    if len(text) % 11 == 0:
        raise G.Rejected
    if len(text) % 7 == 0 and model == G.PRIMARY:
        return {"content": "not json", "prompt_tokens": 10, "completion_tokens": 5}
    return {"content": json.dumps({"neutral_text": text.replace(" the ", " a ")}), "prompt_tokens": 10, "completion_tokens": 5}


_ECHO = _cascade(False).replace(_PAIRS, f"pairs as (select doc_id as post_id, lang as style_type, text as response_clean, {sql.strip(chr(39).join(['replace(text, ', ' the ', ', ', ' a ', ')']))} as candidate from documents)")


@query(
    f"""with {_ECHO}, e as (select v.*, length(response_clean) % 11 = 0 as refused, length(response_clean) % 7 = 0 as again from validated v)
    select post_id, case when refused then 2 when again then 2 else 1 end as n_attempts, refused or again as used_fallback, case when refused then 0 when again then 30 else 15 end as tokens,
    case when refused then 'provider_rejected:Rejected' else failure_reason end as failure_reason, not refused and failure_reason is null as synthetic_ok,
    md5(case when refused then '' else neutralized_clean end) as synthetic_input, case when not refused then jaccard end as jaccard from e"""
)
def neutralized_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("response_clean"))
    out = G.neutralize(d, _echo, concurrency=4)
    return out.select(
        "post_id", F.size("attempts").alias("n_attempts"), "usage.used_fallback", F.col("usage.usage_total_tokens").alias("tokens"), "failure_reason", "synthetic_ok",
        F.md5("synthetic_input").alias("synthetic_input"), "jaccard",
    )


def _letter_counts(texts: list[str]) -> list[list[float]]:
    """A vector that SQL can spell too: how often some letters occur, and the text's length."""
    return [[float(t.count(c)) for c in "etaoin"] + [float(len(t) + 1)] for t in texts]


def _counts(x: str) -> str:
    return "[" + ", ".join(f"cast(length({x}) - length(replace({x}, '{c}', '')) as double)" for c in "etaoin") + f", cast(length({x}) + 1 as double)]"


_SIMILAR = f"""t as (select u.conv_id, u.turn, list_cosine_similarity({_counts('u.text')}, {_counts('a.text')}) as c
from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 and u.role = 'user' and a.role = 'assistant')"""


@query(f"with {_SIMILAR} select conv_id, turn, round(c, 6) as cosine from t")
def text_cosines(spark, sf_dir):
    return E.cosine_scores(turns(spark, sf_dir), "input", "response", _letter_counts)[0].select("conv_id", "turn", F.round("cosine", 6).alias("cosine"))


@query(f"with {_SIMILAR} select round(avg(c), 6) as mean, round(median(c), 6) as median, round(stddev_pop(c), 6) as std, round(min(c), 6) as min, round(max(c), 6) as max, count(c) as n from t")
def text_cosine_summary(spark, sf_dir):
    return E.cosine_scores(turns(spark, sf_dir), "input", "response", _letter_counts)[1]
