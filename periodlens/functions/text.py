"""Text rules as native column expressions; no Python worker is involved.

Java's ``\\w`` and ``\\s`` are ASCII only. The rules need Unicode words, so the classes are
spelled out and give the same answer in Java, RE2 and Python.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and the patterns of the text rules.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
URL_GRAPH = rf"https?://[^{SPACE}]+"
URL_CLASSICAL = rf"(http|www)[^{SPACE}]+"
URL_FILTER = rf"http[^{SPACE}]"
MENTION_GRAPH = rf"@[{WORD}]+"
MENTION_HANDLE = r"@[a-zA-Z0-9_]+:?"
MENTION_CLASSICAL = rf"@[^{SPACE}]+"
HASHTAG = rf"#[{WORD}]+"
RETWEET = r"rt @?[a-zA-Z0-9_]+:?"
RETWEET_FILTER = r"rt @?[a-zA-Z0-9_]+:? "
NONWORD_RUN = rf"[^{WORD}]+"
TERM = rf"[{WORD}]{{2,}}"
NULL_TEXT = "[Empty Tweet]"
NO_TEXTS = "[No Tweets]"


def lower_text(text: Column) -> Column:
    return F.lower(text)


def strip_urls(text: Column, mode: str = "graph") -> Column:
    return F.regexp_replace(text, {"graph": URL_GRAPH, "classical": URL_CLASSICAL}[mode], "")


def strip_mentions(text: Column, mode: str = "graph") -> Column:
    pattern = {"graph": MENTION_GRAPH, "handle": MENTION_HANDLE, "classical": MENTION_CLASSICAL}
    return F.regexp_replace(text, pattern[mode], "")


def strip_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, HASHTAG, "")


def nonword_to_space(text: Column) -> Column:
    return F.regexp_replace(text, NONWORD_RUN, " ")


def strip_retweet_tokens(text: Column, anchored: bool = False) -> Column:
    """Remove ``rt name``. Unanchored it also eats the end of words such as "support them"."""
    return F.regexp_replace(text, (rf"(?<![{WORD}])" if anchored else "") + RETWEET, "")


def normalise_whitespace(text: Column) -> Column:
    """Every single whitespace character, and every plus sign, becomes a space."""
    return F.regexp_replace(text, rf"[{SPACE}+]", " ")


def tokenize(text: Column) -> Column:
    """Whitespace tokens, empties dropped."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def distinct_words(text: Column) -> Column:
    """First occurrence of every word, in order, joined by single spaces."""
    return F.array_join(F.array_distinct(tokenize(text)), " ")


def clean_graph(text: Column, anchored: bool = False) -> Column:
    """The graph cleaner.

    Once non-word runs are single spaces no ``@``, ``:`` or ``+`` is left, so the later handle,
    non-word and whitespace rules cannot change anything that the final word split does not
    already settle; they are left out, which saves three regex passes per post. The same holds
    for whitespace other than the space.
    """
    text = strip_hashtags(strip_mentions(strip_urls(lower_text(text))))
    words = F.split(strip_retweet_tokens(nonword_to_space(text), anchored), " ")
    return F.array_join(F.array_remove(F.array_distinct(words), ""), " ")


def remove_stopwords(words: Column, stopwords: Iterable[str]) -> Column:
    """Membership filter that keeps repeated words. The list becomes one hash set in the plan."""
    stop = sorted(set(stopwords))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def _ml_text(text: Column) -> Column:
    text = strip_mentions(strip_urls(lower_text(text), "classical"), "classical")
    return F.regexp_replace(text, rf"[^{WORD}{SPACE}#]", "")


def ml_words(text: Column, stopwords: Iterable[str] = ()) -> Column:
    return remove_stopwords(tokenize(_ml_text(text)), stopwords)


def explore_words(text: Column, stopwords: Iterable[str] = ()) -> Column:
    text = F.regexp_replace(lower_text(text), rf"[^{WORD}{SPACE}]", "")
    return remove_stopwords(tokenize(F.regexp_replace(text, r"\p{Nd}+", "")), stopwords)


def clean_ml(text: Column, stopwords: Iterable[str] = ()) -> Column:
    return F.array_join(ml_words(text, stopwords), " ")


def clean_explore(text: Column, stopwords: Iterable[str] = ()) -> Column:
    return F.array_join(explore_words(text, stopwords), " ")


def has_url(text: Column) -> Column:
    return F.lower(text).rlike(URL_FILTER)


def is_retweet(text: Column) -> Column:
    return F.lower(text).rlike(RETWEET_FILTER)


def has_mention(text: Column) -> Column:
    return text.contains("@")


def is_clean(text: Column) -> Column:
    """True for a non-null text without URL, retweet form or ``@``; the cheapest test is first."""
    return text.isNotNull() & ~has_mention(text) & ~has_url(text) & ~is_retweet(text)


def extract_hashtags(text: Column) -> Column:
    return F.filter(tokenize(text), lambda w: w.startswith("#"))


def terms(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def text_length(text: Column) -> Column:
    return F.char_length(text)


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def epoch_date(ms: Column) -> Column:
    """UTC calendar day of an epoch in milliseconds, whatever the session time zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86400000).cast("int"))


def epoch_year(ms: Column) -> Column:
    return F.year(epoch_date(ms))


def with_period_context(text: Column, period: Column, style: str = "inference") -> Column:
    period = period.cast("string")
    if style == "inference":
        return F.concat(F.lit("Period: "), period, F.lit(". "), text)
    if style == "training":
        return F.concat(F.lit("[Period: "), period, F.lit("] "), text)
    raise ValueError(f"unknown style {style!r}")


def null_placeholder(text: Column) -> Column:
    return F.coalesce(text, F.lit(NULL_TEXT))


def empty_list_placeholder(texts: Column) -> Column:
    """Null members become the empty-text marker, an empty or null list the no-texts marker."""
    filled = F.transform(texts, null_placeholder)
    return F.when(F.size(F.coalesce(texts, F.array())) > 0, filled).otherwise(
        F.array(F.lit(NO_TEXTS))
    )


def null_label(label: Column) -> Column:
    """A label that could not be produced counts as "no event"."""
    return F.coalesce(label, F.lit(0))


def make_id(match: Column, period: Column) -> Column:
    return F.concat_ws("_", match.cast("string"), period.cast("string"))


def id_match(id_: Column) -> Column:
    return F.split_part(id_, F.lit("_"), F.lit(1)).cast("int")


def id_period(id_: Column) -> Column:
    return F.split_part(id_, F.lit("_"), F.lit(2)).cast("int")


def digest_number(*cols: Column | int | str, digits: int = 12) -> Column:
    """A number of ``digits`` hexadecimal digits (15 at most) that depends on the values alone.

    It is the head of the MD5 digest of the values joined by ``-``, so other engines can work it
    out too. Nulls are left out of the joined text.
    """
    parts = [(c if isinstance(c, Column) else F.lit(c)).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, digits), 16, 10).cast("bigint")


def dedup_key(*cols: Column) -> Column:
    return digest_number(*cols, digits=15)


def fixed_digits(value: Column, digits: int) -> Column:
    """Fixed-point text with trailing zeros and a bare point removed: 0.50 -> 0.5, 2.00 -> 2.

    Values exactly half way between two results go to the even one.
    """
    value = value.cast("double")
    eighths = value * 2 ** (digits + 1)
    value = F.when(eighths == F.floor(eighths), F.bround(value, digits)).otherwise(value)
    text = F.format_string(f"%.{digits}f", value)
    text = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    return F.when(value.isNotNull(), text)


def scientific(value: Column) -> Column:
    """One-digit scientific text; the exponent loses its leading zero when negative: 1.0e-4, 1.0e-10."""
    return F.when(value.isNotNull(), F.replace(F.format_string("%.1e", value.cast("double")), F.lit("e-0"), F.lit("e-")))


def to_number(text: Column) -> Column:
    """Numbers from text; anything unreadable is null."""
    return text.try_cast("double")
