"""Building blocks of the DuckDB twins: the text functions as SQL expressions."""

from __future__ import annotations

from ..functions.overlap import JACCARD_BINS, JACCARD_TOP
from ..functions.text import CTA_PATTERNS

_WS = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD, NUMBER = r"[\p{L}\p{N}_]+", r"\p{Nd}+(?:[.,]\p{Nd}+)?"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{_WS}]+$', '')"


def normalize(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[{_WS}]+', ' ', 'g'))"


def text_hash(x: str) -> str:
    return f"md5({normalize(x)})"


# The patterns of functions.text.CLEAN_PATTERNS in DuckDB's syntax, which spells blanks and case flags otherwise.
def clean(x: str) -> str:
    for p in (
        r"@[A-Za-z0-9_]{4,}", rf"https?://t(?:elegram)?\.me/[^{_WS}]+", rf"https?://[^{_WS}]+", r"#[\p{L}\p{N}_]+", r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
        r"(?im)^.*(подпис(ывайтесь|ка)|ставь\s+лайк|жми\s+👇).*$",
    ):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return strip(f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g')")


def lines(x: str) -> str:
    parts = f"string_split_regex({x}, '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"(case when {parts}[-1] = '' then {parts}[:len({parts}) - 1] else {parts} end)"


def strip_cta(x: str) -> str:
    pattern = "(?i)" + "|".join(CTA_PATTERNS)
    return strip(f"array_to_string(list_filter({lines(x)}, lambda l: not regexp_matches(l, '{pattern}')), chr(10))")


def sentences(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({strip(x)}, '([.!?])[{_WS}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def heuristic_brief(x: str, n: int = 5) -> str:
    s = sentences(strip_cta(x))
    facts = f"array_to_string(list_transform({s}[2:{n + 1}], lambda f: '- ' || f), chr(10))"
    return f"case when len({s}) = 0 then {strip_cta(x)} when len({s}) = 1 then 'Topic: ' || {s}[1] else 'Topic: ' || {s}[1] || chr(10) || 'Facts:' || chr(10) || {facts} end"


def paragraphs(x: str) -> str:
    p = f"list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"(case when len({p}) = 0 then [{strip(x)}] else {p} end)"


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{NUMBER}'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def word_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def blank_words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '[{_WS}]+'), lambda w: w <> ''))"


def ngrams(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"


def shingle_ctes(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in {name}(key, g): the distinct 5-grams of each text, of fewer words the words."""
    leads = ", ".join(f"lead(w, {k}) over (partition by {key} order by i) as w{k}" for k in range(1, 5))
    return f"""{name}_t as (select {key}, list_filter(string_split({normalize(text)}, ' '), lambda w: w <> '') as t from {source}),
    {name}_w as (select {key}, len(t) as m, unnest(t) as w, unnest(range(1, len(t) + 1)) as i from {name}_t), {name}_a as (select *, {leads} from {name}_w),
    {name} as (select distinct {key}, case when m < 5 then w else w || ' ' || w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 end as g from {name}_a where m < 5 or w4 is not null)"""


def set_jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) + len({b}) = 0 then 1.0 else {both} / greatest(len({a}) + len({b}) - {both}, 1) end)"


def jaccard(a: str, b: str) -> str:
    return set_jaccard(word_set(a), word_set(b))


def numbers_preserved(a: str, b: str) -> str:
    return f"(case when len({numbers(a)}) = 0 then true else len(list_intersect({numbers(a)}, {numbers(b)})) / len({numbers(a)}) >= 0.8 end)"


def jaccard_bin(v: str) -> str:
    whens = " ".join(f"when {v} < {t} then '{label}'" for t, label in JACCARD_BINS)
    return f"(case when {v} is null then null {whens} else '{JACCARD_TOP}' end)"


def overlap_ctes(pairs: str, key: str, a: str, b: str, most: int = 8, copy: int = 4) -> str:
    """CTEs that end in ngram_overlap(key, longest, copied) of the token lists a and b of a relation.

    Words become rows, n-grams the words ahead of a row, and shared n-grams equi-joins.
    """
    leads = ", ".join(f"lead(w, {k}) over (partition by {key}, side order by i) as w{k}" for k in range(1, most))
    sides = f"select {key}, 'a' as side, {a} as t from {pairs} union all select {key}, 'b', {b} from {pairs}"
    gram = lambda n: " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, n))])
    grams = " union all ".join(f"select {key}, side, {n} as n, {gram(n)} as g from ahead where {'w' if n == 1 else f'w{n - 1}'} is not null" for n in range(1, most + 1))
    return f"""sides as ({sides}), wordrows as (select {key}, side, unnest(t) as w, unnest(range(1, len(t) + 1)) as i from sides), ahead as (select *, {leads} from wordrows),
    grams as ({grams}), ga as (select distinct {key}, n, g from grams where side = 'a'), gb as (select {key}, n, g, count(*) as c from grams where side = 'b' group by 1, 2, 3),
    met as (select gb.{key}, gb.n, gb.g, gb.c from gb join ga on ga.{key} = gb.{key} and ga.n = gb.n and ga.g = gb.g),
    longs as (select {key}, max(n) as longest, sum(case when n = {copy} then c else 0 end) as copied from met group by 1),
    alls as (select {key}, sum(c) as total from gb where n = {copy} group by 1),
    ngram_overlap as (select p.{key}, coalesce(l.longest, 0) as longest, coalesce(l.copied, 0) / greatest(coalesce(t.total, 0), 1) as copied from {pairs} p left join longs l on l.{key} = p.{key} left join alls t on t.{key} = p.{key})"""
