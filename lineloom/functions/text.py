"""Lines, tokens and indentation as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as the grammar has it: Unicode's, and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]"


def fold(c) -> Column:
    """ASCII lower case; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def tokens(c) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def indent(c) -> Column:
    """Characters of white space before the first other one."""
    return F.length(F.regexp_extract(c, r"^(?U)([\s\x1c-\x1f]*)", 1))


def body(c) -> Column:
    """The line without white space around it."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(c) -> Column:
    """Physical lines: empty text has none, and a line end at the end opens no new one."""
    text = F.coalesce(c, F.lit(""))
    closed = F.regexp_replace(text, "(\r\n|\r|\n)$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(closed, "\r\n|\r|\n"))


def short_hash(c) -> Column:
    return F.substring(F.sha2(c, 256), 1, 20)


def normal_name(c) -> Column:
    """Names of views compared without regard to case and runs of white space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


#: Words that say nothing of which view is meant.
TERMS_LEFT_OUT = ("view", "views", "the", "of", "a", "an", "and", "command", "family", "address")


def terms(c) -> Column:
    """Distinct words of a text for retrieval, without the commonest."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, TERMS_LEFT_OUT)))


def dominates(a: Column, b: Column) -> Column:
    """Vector a is nowhere larger than b and somewhere smaller, over their common length; false if either is empty."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return F.forall(F.zip_with(x, y, lambda p, q: p <= q), lambda v: v) & F.exists(F.zip_with(x, y, lambda p, q: p < q), lambda v: v)


def osa_within(a: Column, b: Column, most: int = 1) -> Column:
    """Whether two words are within an edit distance in which swapping neighbours is one edit.

    One swap makes two plain edits: words at plain distance 2 are met again with the place where they first differ swapped.
    """
    plain = F.levenshtein(a, b)
    if most < 1:
        return plain == 0
    at = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    swapped = F.concat(F.substr(a, F.lit(1), at), F.substr(a, at + 2, F.lit(1)), F.substr(a, at + 1, F.lit(1)), F.substr(a, at + 3))
    return (plain <= most) | (F.length(a) == F.length(b)) & (F.levenshtein(swapped, b) <= most - 1)
