"""The opN_ queries over the standard tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_shards import shard

    return shard(read_table(spark, sf_dir, "documents"), 24)


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantise, top_k

    vectors = quantise(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


ORACLES["op7_exact_top_k"] = """
with v as (
  select vec_id as id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.id as query_id, c.id as vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.id % 50 = 0 and q.id <> c.id and len(q.v) = len(c.v)
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents"))


ORACLES["op5_secret_scan"] = r"""
with kinds(kind, ord, pattern, body, whole) as (values
  ('assign', 1, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=\-]+)', 12, 0), ('access', 2, '(AKIA)([A-Z0-9]+)', 1, 18), ('hex', 3, '()([0-9a-f]+)', 16, 0),
  ('github', 4, '(gh[pousr]_)([A-Za-z0-9]+)', 36, 0), ('jwt', 5, '(eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.)([A-Za-z0-9_\-]+)', 16, 0)
), d as (select row_number() over () as rn, doc_id, coalesce(text, '') as t from documents),
cut as (select rn, kinds.*, string_split(regexp_replace(t, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) as parts from d, kinds),
matched as (select rn, kind, ord, pattern, body, whole, len(parts[1]) as head, unnest(parts[2:]) as part, unnest(range(2, len(parts) + 1)) as k from cut where len(parts) > 1),
placed as (
  select *, split_part(part, chr(2), 1) as m, head + coalesce(sum(len(part) - 1) over (partition by rn, kind order by k rows between unbounded preceding and 1 preceding), 0) as s from matched
), spans as (
  select rn, kind, ord, s, kind || ':' || cast(s as bigint) || ':' || cast(s + len(m) as bigint) as span from placed where len(regexp_extract(m, pattern, 2)) >= body and len(m) >= whole
), own as (
  select rn, count(*) filter (where ord = 1) as n_assign, count(*) filter (where ord = 2) as n_access, count(*) filter (where ord = 3) as n_hex,
    string_agg(span, ',' order by s, ord) filter (where ord <= 3) as base, string_agg(span, ',' order by s, ord) as spans from spans group by rn
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join own on own.rn = d.rn
"""


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op6_benchmark_decontamination"] = r"""
with d as (
  select row_number() over () as rn, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select cast(item_id as varchar) as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bi as (
  select item, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0
), bw as (
  select distinct item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win from bi
), di as (
  select rn, w, s.size as size, unnest(range(1, len(w) - s.size + 2)) as i from d join (select distinct size from bw) s on len(d.w) >= s.size
), met as (
  select di.rn, di.i, di.size, bw.item from di join bw on di.size = bw.size and array_to_string(list_slice(di.w, di.i, di.i + di.size - 1), ' ') = bw.win
), hit as (
  select rn, count(distinct p) as n_hit from (select rn, unnest(range(i, i + size)) as p from (select distinct rn, i, size from met)) group by rn
), items as (
  select rn, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rn, item from met where item is not null) group by rn
)
select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items,
  sha256(coalesce(t.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join hit h on h.rn = d.rn left join items t on t.rn = d.rn
"""


@query
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    documents = read_table(spark, sf_dir, "documents")
    return score(documents, train(documents, read_table(spark, sf_dir, "labels")))


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import Tokenizer

    return Tokenizer(spark).report(read_table(spark, sf_dir, "documents"))


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import classes_of

    return classes_of(read_table(spark, sf_dir, "documents"))


ORACLES["op1_ngram_jaccard_join"] = r"""
with recursive d as (
  select row_number() over () as rn, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as materialized (
  select distinct rn, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as g from d
), n as materialized (select rn, count(*) as n from s group by rn), met as (
  select a.rn as a, b.rn as b, count(*) as c from s a join s b on a.g = b.g and a.rn < b.rn group by 1, 2
), linked as materialized (
  select a, b from met join n x on x.rn = a join n y on y.rn = b where 100 * c >= 80 * (x.n + y.n - c)
), both_ways as materialized (select a, b from linked union all select b, a from linked),
reach as (select rn as node, rn as root from d union select e.b, r.root from reach r join both_ways e on e.a = r.node),
least as (select node, min(doc_id) as component_id from reach join d on d.rn = root group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(l.component_id, d.doc_id) as component_id
from d left join n on n.rn = d.rn left join least l on l.node = d.rn
"""


@query
def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import deduplicate

    return deduplicate(read_table(spark, sf_dir, "documents"))


ORACLES["op2_repeated_substrings"] = r"""
with d as materialized (select row_number() over () as rn, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
parts as (select rn, len(h) // 2 as n, unnest(range(0, len(h) // 2, 2048)) as o, h from d where len(h) >= 400),
cut as materialized (select rn, o, substr(h, 2 * o + 1, 2 * 2048 + 398) as p, least(2048, n - 199 - o) as k from parts where n - 199 - o > 0),
windows as materialized (select rn, o + i as i, md5(substr(p, 2 * i + 1, 400)) as g from (select rn, o, p, unnest(range(0, k)) as i from cut)),
again as (select g from windows group by g having count(*) > 1),
found as (select rn, i, lag(i) over (partition by rn order by i) as before from windows where g in (select g from again)),
runs as (select rn, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by rn order by i) as run from found),
spans as (select rn, run, min(i) as s, max(i) + 200 as e from runs group by rn, run),
gaps as (select rn, run, s, e, coalesce(lag(e) over (partition by rn order by run), 0) as b from spans),
cleared as (
  select rn, sum(e - s) as n_removed, count(*) as n_spans, max(e) as last_e, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' order by run) as kept from gaps join d using (rn) group by rn
)
select d.doc_id, len(d.h) // 2 as n_bytes, cast(coalesce(c.n_removed, 0) as bigint) as n_removed, coalesce(c.n_spans, 0) as n_spans,
  sha256(unhex(coalesce(c.kept || substr(d.h, 2 * c.last_e + 1), d.h))) as kept_sha256
from d left join cleared c on c.rn = d.rn
"""


@query
def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import deduplicate

    return deduplicate(read_table(spark, sf_dir, "documents"), min_words=1)


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses, templates_of

    return scan_licenses(read_table(spark, sf_dir, "documents"), templates_of(spark))


def _license_sql() -> str:
    """A copy of a template's words is found by pairs of equal runs, its neighbouring diagonals by a self-join."""
    from .license_templates import NOTICES, PHRASES, STATEMENTS

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {quoted(label)}, {i < len(PHRASES)}, {quoted(text)})" for i, (label, text) in enumerate(PHRASES + STATEMENTS + NOTICES))
    return rf"""
with d as materialized (
  select row_number() over () as rn, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), t as (
  select id, label, base, len(w) as n, least(len(w), case when len(w) < 4 then 2 else 4 end) as k, w from (
    select id, label, base, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from (values {listed}) as v(id, label, base, text)
  )
), tg as materialized (
  select id, label, base, n, k, tp, array_to_string(w[tp + 1:tp + k], ' ') as run from (select *, unnest(range(0, n - k + 1)) as tp from t)
), dg as (
  select rn, k, p, array_to_string(w[p + 1:p + k], ' ') as run from (select rn, w, k, unnest(range(0, len(w) - k + 1)) as p from d, (select distinct k from tg) where len(w) >= k)
), v as materialized (
  select rn, id, label, base, n, tg.k, p, tp, p - tp as diag, case when n >= 64 and not base then 8 else 0 end as slack from dg join tg on dg.k = tg.k and dg.run = tg.run
), near as materialized (
  select a.rn, a.id, a.label, a.base, a.n, a.k, a.diag, b.p, b.tp from (select distinct rn, id, label, base, n, k, diag, slack from v) a join v b on a.rn = b.rn and a.id = b.id and abs(a.diag - b.diag) <= a.slack
), covered as (
  select rn, id, diag, count(distinct x) as c from (select rn, id, diag, unnest(range(tp, tp + k)) as x from near) group by all
), spans as (
  select rn, id, label, base, n, diag, min(p) as s, max(p + k) as e from near group by all
), scored as (
  select rn, label, base, s, c / greatest(n, e - s) as score from spans join covered using (rn, id, diag)
), own as (
  select rn, count(*) filter (where base and score = 1) as n_base, min(s) filter (where base and score = 1) as first_word, max(s) filter (where base and score = 1) as last_word,
    string_agg(distinct label, ',' order by label) filter (where base and score = 1) as base_labels, string_agg(distinct label, ',' order by label) filter (where score >= 0.8) as labels, max(score) as score
  from scored group by rn
)
select d.doc_id, len(d.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
from d left join own on own.rn = d.rn
"""


ORACLES["op11_license_scan"] = _license_sql()


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group_variants

    return group_variants(read_table(spark, sf_dir, "documents"))


ORACLES["op12_spelling_variants"] = r"""
with recursive t as materialized (
  select list_transform(range(0, 256), lambda i: list_reduce([cast(i as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as crc
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents
), counted as (select doc_id, run, count(*) as c from runs where len(run) >= 6 group by all),
bytes as (select run, c, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from counted),
hashed as (
  select run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: cast('0x' || substr(x, i, 2) as bigint))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) as h from bytes, t
), shown as (
  select case when h % 199 = 0 then substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) else run end as word, c from hashed
), w as materialized (select word, cast(sum(c) as bigint) as n from shown where len(word) >= 6 group by word having sum(c) >= 5),
cut as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, len(word) + 1)) as i from w)),
near as materialized (
  select a.word, b.word as near from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select word, rest from cut where rest in (select word from w)
  union select rest, word from cut where rest in (select word from w)
), best as (
  select near.word, count(*) as n_near, max(o.n) as m, arg_min(o.word, struct_pack(a := -o.n, b := o.word)) as o from near join w o on o.word = near.near group by near.word
), forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * w.n then o end as form, case when m >= 5 * w.n then m end as form_n from w left join best using (word)
), follow as (
  select word, word as root from forms union all select follow.word, forms.form from follow join forms on forms.word = follow.root where forms.form is not null
)
select forms.word, forms.form, follow.root, forms.n, forms.n_near, forms.form_n
from forms join follow on follow.word = forms.word join forms e on e.word = follow.root where e.form is null
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
with l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by coalesce(text, '')) as first from documents
), m as materialized (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > first, false)] as fails
  from d left join l on l.doc_id = d.doc_id
), c as materialized (select part, fails, count(*) as c, sum(good) as good, sum(toxic) as toxic from m group by all),
f(x, name) as (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
orders as (
  select [a.x, b.x, c.x, d.x, e.x] as o, a.name || b.name || c.name || d.name || e.name as filter_order
  from f a join f b on b.x <> a.x join f c on c.x not in (a.x, b.x) join f d on d.x not in (a.x, b.x, c.x) join f e on e.x not in (a.x, b.x, c.x, d.x)
), steps as (select filter_order, step, o[step] as k, o[1:step - 1] as before from (select *, unnest(range(1, 6)) as step from orders)),
seen as (
  select part, filter_order, step, k, c, good, toxic, fails[k] as bad, len(list_filter(before, lambda x: fails[x])) > 0 as gone, len(list_filter(fails, lambda x: x)) = 1 as alone from steps, c
), counted as materialized (
  select part, filter_order, step, k, coalesce(sum(c) filter (where not bad and not gone), 0) as kept, coalesce(sum(c) filter (where bad and not gone), 0) as removed, coalesce(sum(c) filter (where bad and gone), 0) as redundant,
    coalesce(sum(c) filter (where bad and alone), 0) as unique_fails, coalesce(sum(good) filter (where bad and not gone), 0) as good_lost, coalesce(sum(toxic) filter (where bad and not gone), 0) as toxic_lost
  from seen group by all
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, k) as bigint) as shapley
from counted
"""
