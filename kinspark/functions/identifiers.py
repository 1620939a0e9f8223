"""Reading of LEI (ISO 17442) and knowledge-base item identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEI_LENGTH = 20


def squeeze(c: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")


def mod97(c: Column) -> Column:
    """ISO 7064 MOD 97-10 remainder of an upper-case alphanumeric string of up to 38 digits.

    Every letter counts as two digits (A = 10 ... Z = 35), so 18 letters and two digits
    are the most that fits.
    """
    digits = c
    for i in range(26):
        digits = F.replace(digits, F.lit(chr(65 + i)), F.lit(str(10 + i)))
    return (digits.cast("decimal(38,0)") % 97).cast("int")


def usable_lei(c: Column) -> Column:
    """The 20-character LEI in ``c``, or null where there is none with right check digits.

    Case, blanks, punctuation and text in front are ignored. Null in, null out.
    """
    tail = F.right(squeeze(c), F.lit(LEI_LENGTH))
    shaped = tail.rlike("^[A-Z0-9]{18}[0-9]{2}$")
    return F.when(shaped, F.when(mod97(tail) == 1, tail))


def usable_qid(c: Column) -> Column:
    """The item identifier in ``c``: Q and digits, the first not 0, at its end; else null."""
    found = F.regexp_extract(squeeze(c), "Q([1-9][0-9]*)$", 0)
    return F.when(found != "", found)


def source_key(c: Column) -> Column:
    """A source name without case and outer blanks; null where nothing is left."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def with_usable_ids(df: DataFrame, lei: str = "lei", qid: str = "wikidata_qid") -> DataFrame:
    """``df`` with ``usable_lei`` and ``usable_qid``, each reading step evaluated once."""
    read = df.withColumns({"_l": F.right(squeeze(F.col(lei)), F.lit(LEI_LENGTH)), "_q": F.regexp_extract(squeeze(F.col(qid)), "Q([1-9][0-9]*)$", 0)})
    shaped = read.withColumns({"_l": F.when(F.col("_l").rlike("^[A-Z0-9]{18}[0-9]{2}$"), F.col("_l")), "usable_qid": F.when(F.col("_q") != "", F.col("_q"))})
    return shaped.withColumn("usable_lei", F.when(mod97(F.col("_l")) == 1, F.col("_l"))).drop("_l", "_q")
