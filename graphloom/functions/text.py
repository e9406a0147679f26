"""Column functions over text: white space, words, tokens, quality measures.

Everything here is an expression of built-in functions, so it stays inside
whole-stage codegen. A null text gives null (or an empty array where stated).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space (29 of them).
WS = "\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# The scripts whose single characters are tokens of their own.
CJK = "\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af"

# A small English list; pass another one where needed.
STOPWORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its no not of on or our she so "
    "such that the their them then there these they this to was we were what when which who will with you your"
).split()


# Short lists for other languages.
STOPWORDS_BY_LANGUAGE = {
    "en": STOPWORDS,
    "de": "aber als am an auch auf aus bei bin bis da das dem den der des die ein eine einer er es ist mit nicht oder sie und von war wir zu zum zur".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se son sur un une vous".split(),
    "es": "al como con de del el ella en es esta este la las lo los mas no o para pero por que se si sin su sus un una y ya".split(),
}


def stopwords_of(language: str) -> list[str]:
    """The stop words of a language (a code such as de or de-AT); English ones where there are none."""
    return STOPWORDS_BY_LANGUAGE.get(language.lower().replace("_", "-").split("-")[0], STOPWORDS)


def strip_outer(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def lookup_key(c: Column) -> Column:
    """The form in which record keys are compared: no outer white space, lower case."""
    return F.lower(strip_outer(c))


def word_line(c: Column) -> Column:
    """The words (maximal runs of a-z and 0-9 in lower case) joined by one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokenize(c: Column, stopwords: list[str] | None = None) -> Column:
    """Search tokens: ASCII alphanumeric runs of two or more, and single CJK characters.

    Stop words are dropped. Null text gives an empty array.
    """
    stop = STOPWORDS if stopwords is None else stopwords
    raw = F.regexp_extract_all(F.lower(c), F.lit(f"([a-z0-9]+|[{CJK}])"), 1)
    keep = F.filter(raw, lambda t: (F.length(t) > 1) | t.rlike(f"[{CJK}]"))
    if stop:
        keep = F.filter(keep, lambda t: ~t.isin(*stop))
    return F.coalesce(keep, F.array().cast("array<string>"))


def strip_page_markers(c: Column) -> Column:
    """Without scanned page markers such as ``[[Page 12 STAT. 34]]``."""
    return F.regexp_replace(c, "\\[\\[Page \\d+ STAT\\. \\d+\\]\\]", "")


def collapse_space(c: Column) -> Column:
    """Three or more line ends become two; five or more blanks become four."""
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {5,}", "    ")


def normalize_text(c: Column) -> Column:
    """Page markers out first, then white space collapsed."""
    return collapse_space(strip_page_markers(c))


def header_sections(c: Column) -> Column:
    """The text cut before each line that starts (after blanks) with 1-6 ``#`` and a space."""
    return F.split(c, f"\n(?=[{WS}&&[^\\n]]*+#{{1,6}} )", -1)


def whitespace_density(c: Column) -> Column:
    """Share of white space among all characters; 0 for an empty text."""
    n = F.length(c)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(c, f"[{WS}]", ""))) / n)


def malformed_ratio(c: Column) -> Column:
    """Broken ligatures (``f`` split from ``i``, ``l`` or ``f``) per word; 0 without words."""
    words = F.size(F.filter(F.split(c, f"[{WS}]+"), lambda w: w != ""))
    hits = F.regexp_count(c, F.lit(f"f[{WS}]+i")) + F.regexp_count(c, F.lit(f"f[{WS}]+l")) + F.regexp_count(c, F.lit(f"f[{WS}]+f"))
    return F.when(words == 0, F.lit(0.0)).otherwise(hits / words)
