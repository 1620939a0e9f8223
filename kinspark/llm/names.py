"""Company names taken apart: what a name keeps through typing, and what it doesn't.

A spelling is folded (look-alikes, accents, widths), words joined without a blank are
parted at the capital, letters written apart are joined, a ticker in parentheses is
dropped, and what stands behind a comma is put in front. Legal forms are set aside, and
so are generic words (of trade, of kinship), which are learnt from the table: a word is
generic if it is common and stands beside many different words, see ``generic_words``.
What is left are the core words, as many as there are, and all numbers, Arabic or Roman.
A name of generic words only has these as its core. A single letter at the beginning is
an initial and a core word; elsewhere it is none. The words of a run of records are
judged once each and the judgements put back in columns.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.functions.aliases import FILLERS, QUOTED
from kinspark.llm.edits import deletions_of, slips
from kinspark.llm.lookalike import LATIN_CYRILLIC, LATIN_GREEK
from kinspark.session import materialize, shuffles_removed

#: Legal forms of companies in wide use and their short forms, without full stops.
LEGAL = [
    "ab", "ad", "ag", "aktiebolag", "aktiengesellschaft", "aps", "as", "asa", "berhad", "bhd", "bt", "bv", "bvba", "co", "company", "corp", "corporation",
    "cv", "doo", "dd", "ead", "eg", "eirl", "eood", "eurl", "ev", "gbr", "gesmbh", "gk", "gmbh", "hf", "inc", "incorporated", "jsc", "kabushiki", "kaisha", "kft", "kg",
    "kgaa", "kk", "lda", "limitada", "limited", "llc", "llp", "lp", "ltd", "ltda", "mbh", "nv", "nyrt", "ood", "ooo", "oy", "oyj", "pjsc", "pl", "plc", "private", "proprietary", "pt",
    "pte", "pty", "public", "publ", "pvt", "rl", "rt", "sa", "sac", "sarl", "sas", "sau", "sca", "scs", "sdn", "se", "sia", "sk", "sl", "snc", "spa", "sprl", "srl", "sro", "uab", "ug", "yk", "zrt",
    "ад", "ао", "еад", "еоод", "зао", "оао", "од", "оод", "ооо", "пао", "株式会社", "有限会社", "合同会社", "有限公司", "股份有限公司", "주식회사",
]
#: Small words that join the words of names.
JOINING = ["the", "and", "et", "und", "och", "og", "ja", "ey", "of", "de", "del", "des", "di", "do", "da", "du", "der", "van", "von", "for"]
#: A word is generic if it makes up one in COMMON of the records at least ...
COMMON = 10_000
#: ... and its neighbours begin in so many different ways, of 64 at most.
BESIDE = 24
#: Letters from which on a word may be a mistyped generic one.
MISTYPED = 5
#: Bytes of city names up to which the countries of cities are broadcast; beyond, they are joined by shuffle.
MAX_BROADCAST_BYTES = 8 << 20
_LOOKALIKE = str.maketrans({b: unicodedata.normalize("NFKD", a)[0] for a, b in LATIN_CYRILLIC + LATIN_GREEK})
_SKIP, _CORE, _TRADE, _NUMBER, _COMMA, _LETTER = range(6)
_JUDGED = dict.fromkeys([*LEGAL, *JOINING], _SKIP)
_ROMAN = re.compile("x{0,3}(?:ix|iv|v?i{0,3})")


def roman(word: str) -> str:
    """The value of a Roman numeral below 40 in digits, '' if the word is none."""
    if not word or not _ROMAN.fullmatch(word):
        return ""
    value = [{"i": 1, "v": 5, "x": 10}[c] for c in word]
    return str(sum(-v if any(v < w for w in value[i + 1 :]) else v for i, v in enumerate(value)))


#: Letters that don't decompose, and how they are written in plain ones.
_SPELT_OUT = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "Æ": "AE", "Œ": "OE", "đ": "d", "Đ": "D"}
_LOST = re.compile(f"[{''.join(_SPELT_OUT)}]")


class _Folding(dict):
    """Table for str.translate, filled as code points are met."""

    def __missing__(self, cp: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not "\u0300" <= c <= "\u036f" and unicodedata.category(c) != "Cf")
        out = _SPELT_OUT.get(plain) or unicodedata.normalize("NFC", plain)
        self[cp] = out
        return out


_FOLDING = _Folding()
_MIXED = re.compile(r"[A-Za-z].*[\u0370-\u052f]|[\u0370-\u052f].*[A-Za-z]")


def fold(text: str) -> str:
    """Look-alikes, accents, widths and blanks brought to plain letters; case is kept."""
    text = text.translate(_FOLDING)
    return text.translate(_LOOKALIKE) if not text.isascii() and _MIXED.search(text) else text


def _judge(word: str, generic: frozenset[str]) -> tuple[int, str]:
    """Class and bare form of a word; a single letter is judged by its place."""
    if word == ",":
        return _COMMA, ""
    bare = word.replace(".", "")
    if bare in _JUDGED:
        return _JUDGED[bare], bare
    if bare.isdigit():
        return _NUMBER, bare.lstrip("0") or "0"
    if len(bare) == 1:
        return _LETTER, bare
    if roman(bare):
        return _NUMBER, roman(bare)
    parts = [x for x in word.split(".") if x]
    if len(parts) > 1 and all(x in _JUDGED or x in generic for x in parts):
        return (_TRADE, parts[0]) if any(x in generic for x in parts) else (_SKIP, bare)
    if bare in generic:
        return _TRADE, bare
    return (_CORE, bare) if bare else (_SKIP, "")


_SPELLED = pa.schema(
    [("rec_id", pa.int64()), ("country", pa.string()), ("kind", pa.int32()), ("stem", pa.int64()), ("lead", pa.int64()), ("n", pa.int32())]
    + [("words", pa.string()), ("num", pa.string()), ("trade", pa.int32()), ("first", pa.bool_())]
)
SPELLED = "rec_id long, country string, kind int, stem long, lead long, n int, words string, num string, trade int, first boolean"


_QUOTED, _TICKER = re.compile(QUOTED), re.compile("[A-Z]{1,8}")


def _aliases(text: str | None) -> list[str]:
    """The aliases in a text, each once, without tickers."""
    text = text.strip() if text else ""
    if text.lower() in FILLERS or _TICKER.fullmatch(text):
        return []
    if text[0] == "[":
        parts = [x[1:-1] for x in _QUOTED.findall(text)]
        if "\\" in text:
            parts = [re.sub(r"\\(.)", r"\1", x) for x in parts]
    else:
        parts = text.replace("|", ";").split(";")
    return [x for x in dict.fromkeys(map(str.strip, parts)) if " " in x or not _TICKER.fullmatch(x)]


_APART = r"(?:^| )\p{L}\.? \p{L}\.?(?: |$)"
_LETTERS = re.compile(r"(?<!\S)[^\W\d_]\.?(?: [^\W\d_]\.?)+(?!\S)")


def _letters(m: re.Match) -> str:
    """Letters that stand apart in one word, with a legal form at their end as a word of its own."""
    run = re.sub("[ .]", "", m[0])
    at = next((i for i in range(len(run)) if run[i:] in _JUDGED), 0)
    return f"{run[:at]} {run[at:]}".strip()


def _where(text: pa.Array, mask: np.ndarray, change) -> pa.Array:
    """``text`` with ``change`` applied where ``mask`` holds."""
    at = np.nonzero(mask)[0]
    return pc.replace_with_mask(text, pa.array(mask), pa.array([change(t) for t in text.take(pa.array(at)).to_pylist()], pa.string())) if len(at) else text


def _words(text: pa.Array) -> pa.Array:
    """The words of every text, in lower case and folded; commas are words."""
    text = pc.fill_null(text, "")
    text = _where(text, ~pc.string_is_ascii(text).to_numpy(zero_copy_only=False), fold)
    text = pc.if_else(pc.is_in(pc.utf8_lower(pc.utf8_trim_whitespace(text)), value_set=pa.array(FILLERS)), "", text)
    text = pc.replace_substring_regex(text, r"\([A-Z]{3,7}\)\s*$", "")
    text = pc.utf8_lower(pc.replace_substring_regex(text, r"([a-z])([A-Z][a-z])", r"\1 \2"))
    text = pc.replace_substring_regex(pc.replace_substring(text, "'", ""), r"[^\p{L}\p{N}.,]+", " ")
    text = _where(text, pc.match_substring_regex(text, _APART).to_numpy(zero_copy_only=False), lambda t: _LETTERS.sub(_letters, t))
    return pc.utf8_split_whitespace(pc.replace_substring(text, ",", " , "))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, how often it occurs in a run of names, and the bits that the beginnings of the words of these names set."""
    for b in batches:
        text = pc.fill_null(b.column(0), "")
        # stored normal forms have lost letters that don't decompose
        lossy = text.filter(pc.match_substring_regex(text, f"[{''.join(_SPELT_OUT)}]"))
        words = _words(pa.concat_arrays([text, pa.array([_LOST.sub("", t) for t in lossy.to_pylist()], pa.string())]))
        per = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = pc.replace_substring(words.flatten(), ".", "").dictionary_encode()
        kinds, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if not len(index):
            continue
        bit = np.array([1 << (zlib.crc32(w[:2].encode()) & 63) if w else 0 for w in kinds], np.uint64)
        string = np.repeat(np.arange(len(per)), per)
        mask = np.zeros(len(per), np.uint64)
        np.bitwise_or.at(mask, string, bit[index])
        beside = np.zeros(len(kinds), np.uint64)
        np.bitwise_or.at(beside, index, mask[string])
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(index, minlength=len(kinds))), pa.array(beside.view(np.int64))], names=["word", "n", "beside"])


def generic_words(names: DataFrame, common: int = COMMON, beside: int = BESIDE) -> frozenset[str]:
    """The generic words of a column of names: common ones that stand beside words of many beginnings.

    A name borne by any share of the records has few neighbours, so its words are none.
    All names are counted, those with letters that normal forms lose also without these; as a generic word makes up one in ``common`` records, there are
    at most ``common`` times the mean number of words of a name, whatever the size of the table.
    """
    rows = names.count()
    counted = names.mapInArrow(_count_words, "word string, n long, beside long").groupBy("word").agg(F.sum("n").alias("n"), F.bit_or("beside").alias("beside"))
    kept = counted.filter((F.col("n") * common >= rows) & (F.bit_count("beside") >= beside) & (F.length("word") > 0))
    with shuffles_removed(names.sparkSession):
        return frozenset(r["word"] for r in kept.select("word").collect())


class Generic:
    """Generic words and a deletion index that finds words one slip away from them."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        self.index: dict[str, list[str]] = {}
        for w in self.words:
            if len(w) >= MISTYPED:
                for d in deletions_of(w):
                    self.index.setdefault(d, []).append(w)

    def near(self, word: str) -> bool:
        return MISTYPED <= len(word) <= 64 and any(slips(word, w, 1) <= 1 for d in deletions_of(word) for w in self.index.get(d, ()))


def _joined(parts: pa.Array, n: np.ndarray, by: str) -> pa.Array:
    """The parts of every text, n each, in one text each."""
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), parts), by)


def take_apart(generic: Generic, rec: pa.Array, country: pa.Array, name: pa.Array, norm: pa.Array, aliases: pa.Array, *kept: pa.Array) -> pa.RecordBatch:
    """Rows of SPELLED and kept columns for the different usable spellings among the texts of every record, in order.

    n counts the core words; words has them with blanks between, two in the order that
    makes the smaller whole. stem is the hash of the core without blanks, of the numbers
    and, where one word is all, of the trade; lead is the stem of the record's first usable
    spelling. trade has a bit for the first letter of each generic word. The first row of
    a record is marked; it alone has the kept columns.
    """
    lists = pa.array([[a, b, *_aliases(c)] for a, b, c in zip(name.to_pylist(), norm.to_pylist(), aliases.to_pylist(), strict=True)], pa.list_(pa.string()))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    words = _words(lists.flatten())
    per = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    strings = len(per)
    coded = words.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    judged = [_judge(w, generic.words) for w in vocabulary]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = lambda values, kind: np.array(values or [0], kind)[index] if len(index) else np.zeros(0, kind)
    bare = pa.array([roman(b) if k == _LETTER and roman(b) else b for k, b in judged], pa.string())
    plain = pa.array([b for _, b in judged], pa.string())
    kind = of([k for k, _ in judged], np.int8)
    string = np.repeat(np.arange(strings), per)
    leading = np.ones(len(index), bool)
    if len(index):
        leading[1:] = (string[1:] != string[:-1]) | (kind[:-1] == _COMMA)
    letter = kind == _LETTER
    kind[letter] = np.where(leading[letter], _CORE, np.where(of([k == _LETTER and roman(b) != "" for k, b in judged], bool)[letter], _NUMBER, _SKIP))
    many = np.bincount(string[kind == _CORE], minlength=strings) >= 3
    suspects = np.nonzero((kind == _CORE) & many[string])[0] if len(index) else np.zeros(0, np.int64)
    if len(suspects):
        # a third core word may be a mistyped generic one
        seen = {i: generic.near(judged[i][1]) for i in np.unique(index[suspects]).tolist()}
        kind[suspects[[seen[i] for i in index[suspects].tolist()]]] = _TRADE
    bared = np.bincount(string[kind == _CORE], minlength=strings) == 0
    if len(index):
        # of generic words only: they are the core
        kind[(kind == _TRADE) & bared[string]] = _CORE
    total = np.cumsum(kind == _COMMA)
    before = np.concatenate(([0], total))[np.cumsum(per) - per]
    behind = total - before[string] > 0 if len(string) else np.zeros(0, bool)

    def parts(wanted: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.nonzero(kind == wanted)[0]
        return at[np.argsort(string[at] * 2 + ~behind[at], kind="stable")], np.bincount(string[at], minlength=strings)

    core, n = parts(_CORE)
    numbers, many_numbers = parts(_NUMBER)
    num = _joined(bare.take(pa.array(index[numbers])), many_numbers, ".")
    start = np.cumsum(n) - n
    trade = np.zeros(strings, np.int64)
    traded = np.nonzero(kind == _TRADE)[0]
    np.bitwise_or.at(trade, string[traded], 1 << of([ord(b[0]) % 31 if b else 0 for _, b in judged], np.int64)[traded])
    trade &= 0x7FFFFFFF
    flat = plain.take(pa.array(index[core]))
    word = lambda i: flat.take(pa.array(start + i, mask=n <= i))
    x, y = word(0), word(1)
    xy, yx = pc.binary_join_element_wise(x, y, ""), pc.binary_join_element_wise(y, x, "")
    turned = pc.and_(pa.array(n == 2), pc.fill_null(pc.less(yx, xy), False))
    whole = pc.if_else(turned, yx, _joined(flat, n, ""))
    alone = pa.array(np.where(n == 1, trade, 0)).cast(pa.string())
    stem = pd.util.hash_array(pc.binary_join_element_wise(whole, num, alone, "/").to_numpy(zero_copy_only=False)).view(np.int64)
    keep = (n > 0) & ((place < 2) | (n > 1))
    at = np.nonzero(keep)[0]
    at = at[~pd.DataFrame({"owner": owner[at], "stem": stem[at]}).duplicated().to_numpy()]
    first = np.full(len(lists), -1)
    first[owner[at][::-1]] = at[::-1]
    rows, leads = pa.array(at), first[owner[at]] == at
    said = pc.if_else(turned, pc.binary_join_element_wise(y, x, " "), _joined(flat, n, " "))
    kept = [c.take(pa.array(owner[at], mask=~leads)) for c in kept]
    columns = [
        rec.take(pa.array(owner[at])), country.take(pa.array(owner[at])), pa.array(np.minimum(place, 2)[at].astype(np.int32)), pa.array(stem[at]),
        pa.array(stem[first[owner[at]]]), pa.array(n[at].astype(np.int32)), said.take(rows), num.take(rows),
        pa.array(trade[at].astype(np.int32)), pa.array(leads),
    ]
    schema = pa.schema([*_SPELLED, *((f"kept{i}", c.type) for i, c in enumerate(kept))])
    return pa.RecordBatch.from_arrays([*columns, *kept], schema=schema)


def _apart(generic: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Generic(generic)
        for b in batches:
            if b.num_rows:
                out = take_apart(known, *b.columns)
                yield out.rename_columns([*_SPELLED.names, *b.schema.names[5:]])

    return run


def with_country(companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """``companies`` with ``country`` as ISO2 from the alias table, else from the city, where it lies in one country; else ''.

    A city lies in a country if nineteen in twenty of its records with a country say so.
    """
    known = F.broadcast(aliases.select(F.lower(F.trim("alias")).alias("said"), F.col("iso2").alias("iso")).dropDuplicates(["said"]))  # a fixed table
    place = F.nullif(F.lower(F.trim("city")), F.lit(""))
    said = companies.withColumn("said", F.lower(F.trim("country"))).withColumn("place", place).join(known, "said", "left")
    counted = said.filter("place IS NOT NULL").groupBy("place", "iso").count()
    places = counted.groupBy("place").agg(F.max_by(F.when(F.col("iso").isNotNull(), F.col("iso")), F.when(F.col("iso").isNotNull(), F.struct("count", "iso"))).alias("home"), F.max(F.when(F.col("iso").isNotNull(), F.col("count"))).alias("most"), F.sum(F.when(F.col("iso").isNotNull(), F.col("count"))).alias("all"), F.count_if(F.col("iso").isNull()).alias("open"))
    homes = materialize(places.filter("open > 0 AND most >= 0.95 * all").select(F.col("place").alias("_place"), "home"), "homes")
    sought = F.when(F.col("iso").isNull(), F.col("place"))
    if (homes.agg(F.sum(F.octet_length("_place") + 32)).first()[0] or 0) <= MAX_BROADCAST_BYTES:
        told = said.join(F.broadcast(homes), sought == F.col("_place"), "left")
        return told.withColumn("country", F.coalesce("iso", "home", F.lit(""))).select(*companies.columns)
    lost = said.filter("iso IS NULL").join(homes, F.col("place") == F.col("_place"), "left").withColumn("country", F.coalesce("home", F.lit("")))
    return said.filter("iso IS NOT NULL").withColumn("country", F.col("iso")).select(*companies.columns).unionByName(lost.select(*companies.columns))


def spellings(companies: DataFrame, aliases: DataFrame, keep: dict[str, Column], generic: Iterable[str] = ()) -> DataFrame:
    """SPELLED, ``form`` and the numbers of ``keep`` for every different usable spelling of every record, written once.

    kind: 0 the name, 1 its stored normal form, 2 an alias. An alias counts only with
    two core words, as tickers and by-names are not unique. form is the hash of
    country and stem. ``generic`` are words known to be generic besides those learnt.
    """
    known = generic_words(companies.select("name")) | frozenset(generic)
    facts = with_country(companies.select("rec_id", "country", "city", "name", "name_norm", "aliases", *[c.cast("long").alias(k) for k, c in keep.items()]), aliases)
    texts = facts.select(F.col("rec_id").cast("long"), "country", "name", "name_norm", "aliases", *keep)
    parts = texts.mapInArrow(_apart(known), ", ".join([SPELLED, *(f"{k} long" for k in keep)]))
    return materialize(parts.withColumn("form", form_of("stem")), "spellings")


def countries_of_lost(spelled: DataFrame) -> DataFrame:
    """(a, b): forms without a country and the form of the one country that all records with their stem agree on."""
    lost = materialize(spelled.filter("country = ''").select("stem", F.col("form").alias("a")).distinct(), "lost")
    homes = spelled.filter("country <> ''").join(lost, "stem").groupBy("stem", "a").agg(F.min("country").alias("country"), F.max("country").alias("high"))
    return homes.filter("country = high").select("a", form_of("stem").alias("b"))


def form_of(stem: str) -> Column:
    """The hash that stands for a country and a stem."""
    return F.xxhash64("country", stem)
