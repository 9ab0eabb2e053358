"""Text expressions with Unicode-aware strip, token estimate and word sets.

All functions take and return columns and stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a Unicode string type defines it: White_Space plus the four information
# separators, as a character class and as the characters themselves.  Explicit classes are
# used instead of \s, \d and \w under (?U), which match the same but cost far more.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
            + "\u2028\u2029\u202f\u205f\u3000")
WORD = r"\p{L}\p{N}_"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space."""
    return F.btrim(c, F.lit(WS_CHARS))


def not_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(rf"[^{WS}]")


def squash(c: Column) -> Column:
    """Collapse every run of white space to one space and strip."""
    return strip(F.regexp_replace(c, rf"[{WS}]+", " "))


def half_even(c: Column, digits: int) -> Column:
    """Round a double half to even at ``digits`` decimals."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def tokens_of_length(n: Column, ratio: float = 4.0) -> Column:
    """Token estimate of a non-blank text of ``n`` characters (at least 1)."""
    ratio = ratio if ratio > 0 else 4.0
    return F.greatest(F.lit(1), F.rint(n / F.lit(float(ratio))).cast("int"))


def estimate_tokens(c: Column, ratio: float = 4.0) -> Column:
    """0 for blank text, else max(1, half-even(length / ratio))."""
    return F.when(not_blank(c), tokens_of_length(F.length(c), ratio)).otherwise(F.lit(0))


def is_upper(c: Column) -> Column:
    """At least one cased letter, all of them upper case."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(c: Column) -> Column:
    """Every run of cased letters starts upper case and goes on lower case."""
    return (c.rlike(rf"[{CASED}]")
            & ~c.rlike(rf"[{CASED}][\p{{Lu}}\p{{Lt}}]")
            & ~c.rlike(rf"(^|[^{CASED}])\p{{Ll}}"))


def title_case(c: Column) -> Column:
    """Upper-case a letter after any non-letter, lower-case the others.

    ``initcap`` only looks at spaces, so the text is cut into letter runs and
    non-letter runs, each run is capitalised, and the runs are joined again.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(rf"([{CASED}]+|[^{CASED}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def words(c: Column) -> Column:
    """Distinct lower-case words of a text, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"([{WORD}]+)"), 1))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    The optimizer may inline a column into a lambda that uses it, which would evaluate it
    once per array element; a one-element array binds it outside.
    """
    return F.transform(F.array(value), body)[0]


def contains_any(c: Column, terms: list[str]) -> Column:
    """True when any term occurs as a substring (terms are literals)."""
    test = F.lit(False)
    for term in terms:
        test = test | F.contains(c, F.lit(term))
    return test


def word_pattern(terms: list[str]) -> str:
    """Alternation of literal terms between word boundaries."""
    body = "|".join(escape(t) for t in terms)
    return rf"(?<![{WORD}])(?:{body})(?![{WORD}])"


def escape(term: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\-" else ch for ch in term)


def normalized_key(c: Column) -> Column:
    """Question key: stripped, lower-cased, white space collapsed."""
    return F.regexp_replace(F.lower(strip(c)), rf"[{WS}]+", " ")
