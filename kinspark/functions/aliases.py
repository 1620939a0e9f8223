"""Alias lists that were written as text, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value, compared in lower case.
FILLERS = ("", "nan", "none", "null", "n/a", "na", "-", "unknown", "pending", "[]")

QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""


def is_filler(c: Column) -> Column:
    """True for null, blank text and filler words."""
    return F.coalesce(F.lower(F.trim(c)).isin(*FILLERS), F.lit(True))


def parse_aliases(c: Column) -> Column:
    """The aliases in ``c``, trimmed, without blanks and fillers, in order, repeats kept.

    Read are bracketed lists of quoted strings (either quote, backslash escapes),
    and texts separated by ``|`` or ``;``. Null and fillers give an empty array.
    """
    text = F.trim(c)
    listed = F.transform(
        F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)),
        lambda x: F.regexp_replace(F.substring(x, 2, F.length(x) - 2), r"\\(.)", "$1"),
    )
    parts = F.when(text.startswith("["), listed).otherwise(F.split(text, r"[|;]"))
    cleaned = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(*FILLERS))
    return F.when(is_filler(c), F.array().cast("array<string>")).otherwise(cleaned)


def count_different(c: Column) -> Column:
    """The number of different aliases in ``c``, ignoring case."""
    return F.size(F.array_distinct(F.transform(parse_aliases(c), F.lower)))
