"""Text functions, Column in and Column out, inside the JVM.

Words, digits and blanks are Unicode-aware here: Java's bare \\w, \\d and \\s are not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches define the results.
WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
BLANKS = r"(?U)\s+"
CLEAN_PATTERNS = [
    r"@[A-Za-z0-9_]{4,}",
    r"https?://t(?:elegram)?\.me/(?U)\S+",
    r"https?://(?U)\S+",
    r"#[\p{L}\p{N}_]+",
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
    r"(?imud)^.*(подпис(ывайтесь|ка)|ставь\s+лайк|жми\s+👇).*$",
]
CTA_PATTERNS = [
    r"подпис(ывайтесь|ывайся|аться|аны|ка|ки)",
    r"жми(те)?\s+(сюда|на\s+ссылку|ниже|👇)",
    r"читайте\s+подробнее",
    r"подробнее\s+по\s+ссылке",
    r"переходи(те)?\s+по\s+ссылке",
    r"(узнай(те)?|смотри(те)?)\s+больше",
    r"подробности\s+(в|на|по)",
    r"ссылка\s+в\s+био",
    r"в\s+описании\s+канала",
]
EMOJI_FEATURE = r"[\x{1F600}-\x{1FAFF}]"


def bind(c: Column, f) -> Column:
    """f of a column that is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def normalize(c: Column) -> Column:
    """Lower case, runs of blanks as one, stripped: the key of exact duplicates."""
    return F.trim(F.regexp_replace(F.lower(c), BLANKS, " "))


def text_hash(c: Column) -> Column:
    return F.md5(normalize(c))


def clean(c: Column) -> Column:
    """Without handles, links, tags, emoji and lines that call to action."""
    for pattern in CLEAN_PATTERNS:
        c = F.regexp_replace(c, pattern, "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def lines(c: Column) -> Column:
    """Lines at any line break; a break at the end begins no further line."""
    return bind(
        F.split(c, r"\R", -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    )


def strip_cta(c: Column) -> Column:
    """Without the lines that match one of CTA_PATTERNS in any case."""
    pattern = F.lit("(?iu)" + "|".join(CTA_PATTERNS))
    return strip(F.array_join(F.filter(lines(c), lambda x: ~F.rlike(x, pattern)), "\n"))


def sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?<=[.!?])(?U)\s+", -1), lambda s: s != "")


def heuristic_brief(c: Column, max_facts: int = 5) -> Column:
    """Topic (the first sentence) and up to max_facts further ones as bullets; no sentence: the text."""

    def build(body: Column, s: Column) -> Column:
        facts = F.transform(F.slice(s, F.lit(2), F.lit(max_facts)), lambda x: F.concat(F.lit("- "), x))
        head = F.concat(F.lit("Topic: "), F.try_element_at(s, F.lit(1)))
        full = F.when(F.size(s) > 1, F.concat_ws("\n", head, F.lit("Facts:"), F.array_join(facts, "\n"))).otherwise(head)
        return F.when(F.size(s) == 0, body).otherwise(full)

    return bind(strip_cta(c), lambda body: bind(sentences(body), lambda s: build(body, s)))


def paragraphs(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.array(strip(c))).otherwise(parts)


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)))


def tokens(c: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def blank_words(c: Column) -> Column:
    """Number of words between blanks."""
    return F.size(F.filter(F.split(c, BLANKS, -1), lambda w: w != ""))


def ngrams(toks: Column, n: int) -> Column:
    """Word n-grams joined by blanks; none from fewer than n words."""
    return bind(
        toks,
        lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>")),
    )


def shingles5(c: Column) -> Column:
    """Distinct 5-grams of the blank-separated normalised text; of fewer words the words."""
    toks = F.filter(F.split(normalize(c), " ", -1), lambda w: w != "")
    return bind(toks, lambda t: F.when(F.size(t) < 5, F.array_distinct(t)).otherwise(F.array_distinct(ngrams(t, 5))))


def shingle_hashes(c: Column) -> Column:
    """64-bit hashes of shingles5, made from word to word without spelling the 5-grams out."""
    words = F.transform(F.filter(F.split(normalize(c), " ", -1), lambda w: w != ""), lambda w: F.xxhash64(w))

    def up_to(w: Column, n: int) -> Column:
        if n == 1:
            return w
        return bind(up_to(w, n - 1), lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(g) - 1), F.slice(w, F.lit(n), F.size(g) - 1), lambda x, y: F.xxhash64(x, y)))

    return bind(words, lambda w: F.array_distinct(F.when(F.size(w) < 5, w).otherwise(up_to(w, 5))))


def features(df, text: str = "text"):
    """df with char_len, n_paragraphs, has_emoji, ends_with_question, source_text_hash and group_id."""
    t = F.col(text)
    return df.withColumns(
        {
            "char_len": F.length(t), "n_paragraphs": F.regexp_count(t, F.lit("\n\n")) + 1, "has_emoji": F.rlike(t, F.lit(EMOJI_FEATURE)),
            "ends_with_question": F.endswith(rstrip(t), F.lit("?")), "source_text_hash": text_hash(t), "group_id": text_hash(t),
        }
    )
