"""Text clean-up, tokenising and small formatting rules as column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentspark.functions import patterns as P


def let(value: Column, body) -> Column:
    """Bind ``value`` once for a ``body`` that mentions it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space from both ends."""
    return F.regexp_replace(c, rf"\A[{P.WHITESPACE}]+|[{P.WHITESPACE}]+\z", "")


def collapse(c: Column) -> Column:
    """Turn each white-space run into one blank and trim the ends."""
    return F.trim(F.regexp_replace(c, rf"[{P.WHITESPACE}]+", " "))


def skill_list(c: Column) -> Column:
    """Comma list -> array of trimmed, non-empty names; order and copies are kept."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda s: s != "")


def parse_skills(text: str) -> list[str]:
    """The skill list of a job run, given as text; an empty list is refused."""
    skills = [s.strip() for s in text.split(",") if s.strip()]
    if not skills:
        raise ValueError("no skills given")
    return skills


def clean_html(c: Column) -> Column:
    """Each tag becomes one blank; entities and inner white space stay as they are."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def sanitize_filename(c: Column, max_len: int = 60) -> Column:
    named = F.when(c.isNull() | (c == ""), F.lit("unknown")).otherwise(c)
    kept = strip(F.regexp_replace(named, rf"[^{P.WORD}{P.WHITESPACE}-]", ""))
    joined = F.substring(F.regexp_replace(kept, rf"[{P.WHITESPACE}]+", "_"), 1, max_len)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("unnamed"))


def text_sanitize(c: Column) -> Column:
    """Keep ASCII letters, digits, blanks and ``. , - / ( ) @ +``; collapse the blanks."""
    return collapse(F.regexp_replace(c, f"[^{P.PROSE_KEPT}]", ""))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{P.WHITESPACE}]")


def simple_normalize(c: Column) -> Column:
    """Lower-case ASCII words separated by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))


def words(c: Column) -> Column:
    """Lower-cased runs of letters, marks, digits and underscores, in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[{P.WORD}\p{{M}}]+"), F.lit(0))


def stop_alpha_normalize(c: Column, stop_words: list[str]) -> Column:
    """Drop stop words and words that are not purely letters; join with blanks."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    kept = F.filter(words(c), lambda w: w.rlike(r"\A\p{L}+\z") & ~F.array_contains(stops, w))
    return F.array_join(kept, " ")


def keyword_tokens(c: Column) -> Column:
    """Distinct keywords of a text: more than two characters and not a stop word.

    Characters outside a-z, 0-9 and white space are deleted, so "ci/cd" gives "cicd".
    """
    kept = F.regexp_replace(F.lower(c), f"[^a-z0-9{P.WEB_WHITESPACE}]", "")
    found = F.regexp_extract_all(kept, F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in P.KEYWORD_STOP_WORDS]))


def title_company(c: Column) -> Column:
    """Split at the first ':' into company and title; without one all of it is the title."""
    parts = F.split(c, ":", 2)
    has_company = c.contains(":")
    return F.struct(
        F.when(has_company, strip(F.get(parts, F.lit(1)))).otherwise(c).alias("title"),
        F.when(has_company, strip(F.get(parts, F.lit(0)))).otherwise(F.lit("")).alias("company"),
    )


def percent_half_up(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half up; 0 where the whole is 0."""
    share = F.floor(F.try_divide(part, whole) * 100 + F.lit(0.5)).cast("int")
    return F.coalesce(share, F.lit(0))


def match_band(score: Column) -> Column:
    return F.when(score >= P.GREAT_MATCH_SCORE, F.lit(P.GREAT_MATCH_TEXT)).otherwise(
        F.lit(P.ADVICE_TEXT)
    )


def upload_status(mime: Column) -> Column:
    """accepted / unsupported (may be picked, cannot be read) / rejected."""
    return (
        F.when(mime.isin(P.READABLE_TYPES), "accepted")
        .when(mime.isin(list(P.ACCEPTED_TYPES.values())), "unsupported")
        .otherwise("rejected")
    )


def whole_word_pattern(literal: str) -> str:
    """Java pattern for ``literal`` between word boundaries, with Python's idea of a word.

    A boundary next to a symbol needs a word character on its other side, which is why
    "c++" is not found as a free-standing word while ".net" is found in "asp.net".
    """
    def is_word(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    before = rf"(?<![{P.WORD}])" if is_word(literal[0]) else rf"(?<=[{P.WORD}])"
    after = rf"(?![{P.WORD}])" if is_word(literal[-1]) else rf"(?=[{P.WORD}])"
    escaped = re.sub(r"([^\w\s])", r"\\\1", literal, flags=re.ASCII)
    return f"{before}{escaped}{after}"


def has_whole_word(text: Column, literal: str) -> Column:
    """``text`` is lower case already. The plain substring test spares most regex runs."""
    literal = literal.lower()
    return text.contains(literal) & text.rlike(whole_word_pattern(literal))
