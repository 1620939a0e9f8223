"""Normal forms of company, metal and country names as column expressions.

All functions take and give string columns. Unless said otherwise a null argument
counts as an empty text.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes that normal forms leave out.
LEGAL_SUFFIXES = (
    "incorporated|corporation|inc|corp|co|company|ltd|plc|sa|ag|gmbh|spa|oyj|kgaa|"
    r"sarl|s\.r\.o\.|pte|llc|lp|bv|nv|ab|as|oy|sas|s\.a\.|s\.p\.a\.|"
    r"limited|limitada|ltda|l\.l\.c\.|jsc|p\.l\.c\."
)
#: Legal suffixes whose comma and full stop display forms leave out.
DISPLAY_SUFFIXES = r"Inc|Corp|Corporation|Ltd|Limited|LLC|L\.L\.C|plc|S\.A|S\.p\.A"
SAFE_NAME = r"^[A-Za-z0-9\s\-&]+$"


@lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Code points with one ASCII letter or sign left after NFKD, what is left, and those with several."""
    single, several = {}, {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        left = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if c.isascii())
        if len(left) == 1:
            single[chr(cp)] = left
        elif left:
            several[chr(cp)] = left
    return "".join(single), "".join(single.values()), several


def to_ascii(c: Column) -> Column:
    """Compatibility decomposition without what is not ASCII: accents go, other scripts vanish.

    Texts in ASCII pass untouched; only texts with a character that decomposes to
    several (a ligature, a fraction) are looked up sign by sign.
    """
    single_from, single_to, several = _ascii_tables()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # folded to one constant
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    drop = lambda x: F.regexp_replace(F.translate(x, single_from, single_to), r"[^\x00-\x7F]", "")
    odd = "[" + "".join(several) + "]"
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).when(c.rlike(odd), drop(spelled)).otherwise(drop(c))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_company_name(c: Column) -> Column:
    """Form for matching: ASCII, lower case, no legal suffixes, only a-z, 0-9, & and -."""
    plain = F.lower(to_ascii(F.coalesce(c, F.lit(""))))
    bare = F.regexp_replace(plain, rf"\b({LEGAL_SUFFIXES})\b\.?", "")
    return _squeeze(F.regexp_replace(bare, r"[^a-z0-9&\-\s]", " "))


def canonicalize_company_name(c: Column) -> Column:
    """Form for display and identifiers: as written, in ASCII letters, digits, blanks, & and -. Null stays null."""
    no_comma = F.regexp_replace(c, rf"(?i),\s+((?:{DISPLAY_SUFFIXES})\.?)", " $1")
    no_stop = F.regexp_replace(no_comma, rf"(?i)\b({DISPLAY_SUFFIXES})\.", "$1")
    return _squeeze(F.regexp_replace(to_ascii(no_stop), r"[^A-Za-z0-9\s\-&]", " "))


def is_canonical_name(c: Column) -> Column:
    """Whether a name has only the signs of display forms; false for null and empty."""
    return F.coalesce(c.rlike(SAFE_NAME), F.lit(False))


def company_id(name: Column, country: Column, safe: bool = False) -> Column:
    """``name:country``; safe: letters, digits and underscores only. Missing parts are Unknown and XX."""
    name, country = F.coalesce(name, F.lit("Unknown")), F.coalesce(country, F.lit("XX"))
    if not safe:
        return F.concat_ws(":", name, country)
    return F.concat_ws("_", F.btrim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")), country)


def normalize_metal_name(c: Column) -> Column:
    """Form for matching: lower case, only a-z, 0-9, blanks, - / ( ) and %."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    # a letter and the accent behind it are one character, and no a-z
    composed = F.regexp_replace(text, r"[a-z]\p{M}+", " ")
    return _squeeze(F.regexp_replace(composed, r"[^a-z0-9\s\-/()%]", " "))


def title_metal_name(c: Column) -> Column:
    """Display form: blanks squeezed, every letter behind a non-letter in upper case, others in lower."""
    chars = F.split(_squeeze(F.coalesce(c, F.lit(""))), "")
    first = lambda x, i: (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}")
    return F.array_join(F.transform(chars, lambda x, i: F.when(first(x, i), F.upper(x)).otherwise(F.lower(x))), "")


def slugify_metal_name(c: Column) -> Column:
    """Key form: a-z, 0-9 and single hyphens for blanks and underscores."""
    text = to_ascii(F.lower(F.trim(F.coalesce(c, F.lit("")))))
    kept = F.regexp_replace(F.regexp_replace(text, r"[\s_]+", "-"), r"[^a-z0-9\-]", "")
    return F.btrim(F.regexp_replace(kept, "-+", "-"), F.lit("-"))


def metal_id(c: Column) -> Column:
    """16 hexadecimal digits that stand for a metal's normal form."""
    return F.substring(F.sha1(F.concat(normalize_metal_name(c), F.lit("|metal"))), 1, 16)


def metal_part(c: Column) -> Column:
    """What stands before the first colon."""
    return F.when(c.contains(":"), F.trim(F.substring_index(c, ":", 1))).otherwise(c)


def form_hint(c: Column) -> Column:
    """What stands behind the first colon; null without one."""
    return F.when(c.contains(":"), F.trim(F.substring(c, F.instr(c, ":") + 1, F.length(c))))


def country_key(c: Column) -> Column:
    """Key of a country's name: trimmed, lower case, straight apostrophes."""
    return F.replace(F.lower(F.trim(c)), F.lit("’"), F.lit("'"))


def join_address(lines: Column) -> Column:
    """Address lines in one, null where they are blank."""
    return F.nullif(F.trim(F.array_join(lines, " ")), F.lit(""))


def qid_of_url(c: Column) -> Column:
    """Item identifier of an entity URL, '' where there is none."""
    return F.when(c.contains("/Q"), F.concat(F.lit("Q"), F.get(F.split(c, "/Q"), F.lit(1)))).otherwise(F.lit(""))


def flat_aliases(aliases: Column, n: int) -> list[Column]:
    """alias1 .. aliasn from a list, null where it is shorter."""
    return [F.get(aliases, F.lit(i)).alias(f"alias{i + 1}") for i in range(n)]


def listed_aliases(n: int) -> Column:
    """The list of alias1 .. aliasn without null and blank ones."""
    return F.filter(F.array(*[F.col(f"alias{i + 1}") for i in range(n)]), lambda a: a.isNotNull() & (F.trim(a) != ""))


def cache_key(name: Column, country: Column) -> Column:
    """``name|country`` as written, missing parts empty."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit("|"), F.coalesce(country, F.lit("")))


def unit_fits_basis(unit: Column, basis: Column) -> Column:
    """Whether a unit occurs in its basis; both null fit, one missing does not."""
    missing = (F.coalesce(unit, F.lit("")) == "") | (F.coalesce(basis, F.lit("")) == "")
    return F.when(missing, unit.isNull() & basis.isNull()).otherwise(F.contains(F.lower(basis), F.lower(unit)))
