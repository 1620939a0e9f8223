"""Mentions of companies in texts, their country, and their resolution."""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from kinspark.operators.resolve import LEAD, SURE, ranked_matches

#: What a mention looks like, words that start none, and words that point to a country.
LEGAL_MENTION = r"(?i)\b([A-Z][A-Za-z0-9&\-]+(?:\s+[A-Z][A-Za-z0-9&\-]+)*)\s+(Inc\.?|Ltd\.?|Corp\.?|Corporation|Limited|Company|plc|LLC|L\.L\.C\.)\b"
CAPITAL_MENTION = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b"
NO_STARTS = ("The", "This", "That", "These", "Those", "There", "When", "Where", "What", "Which")
COUNTRY_TERMS = {
    "united states": "US", "usa": "US", "america": "US", "american": "US", "united kingdom": "GB", "uk": "GB", "britain": "GB", "british": "GB",
    "england": "GB", "australia": "AU", "australian": "AU", "canada": "CA", "canadian": "CA", "germany": "DE", "german": "DE", "france": "FR",
    "french": "FR", "japan": "JP", "japanese": "JP", "china": "CN", "chinese": "CN", "india": "IN", "indian": "IN", "brazil": "BR",
    "brazilian": "BR", "south africa": "ZA", "south african": "ZA", "switzerland": "CH", "swiss": "CH", "netherlands": "NL", "dutch": "NL",
    "holland": "NL", "sweden": "SE", "swedish": "SE", "norway": "NO", "norwegian": "NO", "denmark": "DK", "danish": "DK", "spain": "ES",
    "spanish": "ES", "italy": "IT", "italian": "IT",
}
CONTEXT = 30
LEGAL_FORMS = ("Inc.", "Inc", "Ltd.", "Ltd", "Corp.", "Corp", "Corporation", "Limited", "Company", "plc", "LLC", "L.L.C.")
#: Texts that are looked through before their mentions are handed on.
RUN = 200
_FORM = re.compile(r"(?<=\s)(?:inc|ltd|corp|limited|company|plc|llc|l\.l\.c\.)", re.I | re.A)
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9&\-]+(?=\s)", re.A)
_BLANKS = re.compile(r"\s*", re.A)
_LETTERS, _INSIDE, _BLANK = frozenset(string.ascii_letters), frozenset(string.ascii_letters + string.digits + "&-"), frozenset(" \t\n\r\f\v")


def _in_word(c: str) -> bool:
    """Whether a character that touches a letter goes on its word."""
    return c == "_" or unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn")


@lru_cache(maxsize=1)
def _capitals() -> re.Pattern:
    """CAPITAL_MENTION with the characters of words spelled out."""
    ranges: list[list[int]] = []
    for cp in filter(lambda cp: _in_word(chr(cp)), range(sys.maxunicode + 1)):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    words = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(rf"(?<![{words}])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,3}}(?![{words}])", re.A)


def _form_end(text: str, at: int) -> int:
    """The end of the legal form at a place, 0 if there is none."""
    for form in LEGAL_FORMS:
        end = at + len(form)
        if text[at:end].lower() == form.lower() and text[at:end].isascii() and (form[-1] == ".") == (end < len(text) and _in_word(text[end])):
            return end
    return 0


def _name_start(text: str, at: int, least: int) -> int:
    """Where the words that stand before a legal form begin, at ``least`` or later; -1 if there are none."""
    found = -1
    while True:
        stop = at
        while stop > least and text[stop - 1] in _BLANK:
            stop -= 1
        if stop == at:
            return found
        start = stop
        while start > least and text[start - 1] in _INSIDE:
            start -= 1
        if start <= stop - 2 and text[start] in _LETTERS and start > 0 and text[start - 1] in _BLANK:
            found = at = start
            continue
        # a word that other signs touch can only be the first
        first = (i for i in range(start, stop - 1) if text[i] in _LETTERS and not (i and _in_word(text[i - 1])))
        return next(first, found)


def _legal(text: str) -> list[tuple[int, int]]:
    """Spans of LEGAL_MENTION, in a time that grows with the text and not with the square of its sentences."""
    found, behind = [], 0
    for m in _FORM.finditer(text):
        if m.start() < behind or not (end := _form_end(text, m.start())):
            continue
        start = _name_start(text, m.start(), behind)
        if start < 0:
            continue
        # the last legal form that words alone lead to
        at = m.start()
        while word := _WORD.match(text, at):
            at = _BLANKS.match(text, word.end()).end()
            end = _form_end(text, at) or end
        found.append((start, end))
        behind = end
    return found


def mentions(text: str) -> list[tuple[int, int]]:
    """Spans of company mentions: with a legal form, or two to four capitalized words; the first of overlapping ones."""
    legal = _legal(text)
    starts, stops = [a for a, _ in legal], [b for _, b in legal]

    def inside(a: int, b: int) -> bool:
        i, j = bisect_right(starts, a) - 1, bisect_left(stops, b)
        return (i >= 0 and a < stops[i]) or (j < len(starts) and starts[j] < b)

    capital = [m.span() for m in _capitals().finditer(text) if not inside(*m.span()) and m[0].split(" ", 1)[0] not in NO_STARTS]
    kept, behind = [], 0
    for a, b in sorted([*legal, *capital], key=lambda x: (x[0], -x[1])):
        if a >= behind:
            kept.append((a, b))
            behind = b
    return kept


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            run = batch.slice(at, RUN)
            out = [(i, a, b, text[max(a - CONTEXT, 0) : b + CONTEXT].strip(" "), text[a:b].strip(" ")) for i, text in enumerate(run.column(1).to_pylist()) for a, b in mentions(text)]
            rows, start, stop, context, mention = zip(*out, strict=True) if out else ((),) * 5
            columns = [run.column(0).take(pa.array(rows, pa.int64())), pa.array(mention, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(context, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "mention", "start", "stop", "context"])


def document_mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mention, start, stop, context) of every mention; null texts have none."""
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text")).filter("_text IS NOT NULL")
    more = [StructField(c, t) for c, t in (("mention", StringType()), ("start", IntegerType()), ("stop", IntegerType()), ("context", StringType()))]
    return texts.mapInArrow(_find, StructType([texts.schema[id_col], *more]))


def inferred_country(text: Column) -> Column:
    """The country that most terms in a text point to, the smaller code among equals; null without terms."""
    lower = F.lower(text)
    codes = F.filter(F.array(*[F.when(F.contains(lower, F.lit(t)), c) for t, c in COUNTRY_TERMS.items()]), lambda c: c.isNotNull())
    votes = F.transform(F.array_distinct(codes), lambda c: F.struct((-F.size(F.filter(codes, lambda x: x == c))).alias("n"), c.alias("c")))
    return F.array_min(votes)["c"]


def document_companies(docs: DataFrame, catalogue: DataFrame, id_col: str, text_col: str, min_confidence: float = 0.75, fallback: str = "auto") -> DataFrame:
    """Companies mentioned in each text: every distinct (mention, country) is resolved once and joined back.

    One row a text and company, at its first mention, in the order of first occurrence.
    """
    country = docs.select(F.col(id_col), inferred_country(F.col(text_col)).alias("hint"))
    found = document_mentions(docs, id_col, text_col).join(country, id_col)
    asked = found.select(F.col("mention").alias("name"), F.col("hint").alias("country")).distinct().withColumn("query_id", F.xxhash64("name", F.coalesce("country", F.lit(""))))
    sure = (
        ranked_matches(asked, catalogue, 2, fallback)
        .filter((F.col("rank") == 1) & (F.col("score") >= SURE) & (F.col("gap") >= LEAD) & (F.col("score") / 100 >= min_confidence))
        .select("query_id", F.col("name").alias("company"), "country", "lei", "wikidata_qid", "score")
    )
    keyed = found.withColumn("query_id", F.xxhash64("mention", F.coalesce("hint", F.lit("")))).drop("hint")
    hits = keyed.join(sure, "query_id")
    order = Window.partitionBy(id_col, "company").orderBy("start", "stop")
    return hits.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "query_id")
