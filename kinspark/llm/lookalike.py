"""Visually identical text with different characters, brought to one consistent form.

Pairs of strings that look the same are collected from the Unicode data (a wide,
narrow, font or ligature form and its plain form, a composed letter and its base
with accents, any blank and the space, an invisible character and nothing) and from
a table of letters that two scripts share in shape. Union-find makes them classes
that are closed under chains. Each class is represented by the member that the
corpus uses most among those in normal form; the counts cover all texts. A
multi-pattern automaton rewrites every text greedily, longest match first.

A letter of another script only counts as a look-alike inside a word that mixes
scripts: words wholly in one script stay as they are. A mixed word takes the script
of its letters that have no look-alike; where all have one, the script that the
corpus uses most.

Defined results: null stays null, an empty text stays empty; the form of a form is
the form itself; repeated rows are rewritten alike; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that share their shape, Latin with Cyrillic and with Greek.
LATIN_CYRILLIC = (
    ("A", "А"), ("B", "В"), ("C", "С"), ("E", "Е"), ("H", "Н"), ("I", "І"), ("J", "Ј"), ("K", "К"), ("M", "М"), ("O", "О"),
    ("P", "Р"), ("S", "Ѕ"), ("T", "Т"), ("X", "Х"), ("Y", "У"), ("a", "а"), ("c", "с"), ("d", "ԁ"), ("e", "е"), ("h", "һ"),
    ("i", "і"), ("j", "ј"), ("o", "о"), ("p", "р"), ("q", "ԛ"), ("s", "ѕ"), ("w", "ԝ"), ("x", "х"), ("y", "у"), ("ë", "ё"),
    ("ï", "ї"), ("Ë", "Ё"), ("Ï", "Ї"), ("Y", "Ү"), ("v", "ѵ"), ("l", "ӏ"), ("G", "Ԍ"), ("Q", "Ԛ"), ("W", "Ԝ"), ("k", "к"),
)
LATIN_GREEK = (
    ("A", "Α"), ("B", "Β"), ("E", "Ε"), ("H", "Η"), ("I", "Ι"), ("K", "Κ"), ("M", "Μ"), ("N", "Ν"), ("O", "Ο"), ("P", "Ρ"),
    ("T", "Τ"), ("X", "Χ"), ("Y", "Υ"), ("Z", "Ζ"), ("o", "ο"), ("v", "ν"), ("i", "ι"), ("p", "ρ"), ("u", "υ"), ("a", "α"),
    ("k", "κ"), ("ó", "ό"), ("í", "ί"),
)
#: Kinds of compatibility forms that look like their plain form.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")
HYPHENS = ("-", "‐", "‑", "−", "﹣")
#: Texts with none but these characters hold nothing to rewrite.
PLAIN = r"^[\x00-\x7FÀ-ıĴ-ľŁ-ňŊ-ž]*$"


def script(ch: str) -> str:
    """LATIN, CYRILLIC or GREEK for their letters, else ''."""
    first = unicodedata.name(ch, "").split(" ")[0]
    return first if first in ("LATIN", "CYRILLIC", "GREEK") and ch.isalpha() else ""


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> list[list[str]]:
        out = defaultdict(list)
        for x in list(self.parent):
            out[self.find(x)].append(x)
        return [sorted(m) for m in out.values()]


@lru_cache(maxsize=1)
def same_shape() -> list[list[str]]:
    """Classes of strings within one script that look the same."""
    classes = Classes()
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category == "Zs":
            classes.union(ch, " ")
        elif category == "Cf" or 0xFE00 <= cp <= 0xFE0F:
            classes.union(ch, "")
        elif 0xAC00 <= cp <= 0xD7A3 or category in ("Cn", "Co", "Cs"):
            continue
        else:
            form = unicodedata.decomposition(ch)
            if not form:
                continue
            kind, _, rest = form.partition(" ") if form[0] == "<" else ("", "", form)
            # of compatibility forms that are no letters or letter numerals, as signs for words, the shape differs
            if not kind or kind in SAME_SHAPE and (kind != "<compat>" or category[0] == "L" or category == "Nl"):
                plain = "".join(chr(int(x, 16)) for x in rest.split())
                if not plain.startswith(" "):  # spacing accents are signs of their own
                    classes.union(ch, plain)
                    if not kind:
                        classes.union(ch, unicodedata.normalize("NFD", ch))
    for h in HYPHENS[1:]:
        classes.union(h, HYPHENS[0])
    return [m for m in classes.members() if len(m) > 1]


@lru_cache(maxsize=1)
def across_scripts() -> list[list[str]]:
    """Classes of letters of different scripts that look the same."""
    classes = Classes()
    for a, b in LATIN_CYRILLIC + LATIN_GREEK:
        classes.union(a, b)
    return classes.members()


class Rewriter:
    """Rewrites texts to the representatives that ``counts`` (of code points) choose."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.table: dict[str, str] = {}
        for members in same_shape():
            normal = [m for m in members if unicodedata.normalize("NFKC", m) == m and not any(unicodedata.category(c) == "Cf" for c in m)]
            best = "" if "" in members else min(normal or members, key=lambda m: (-self._used(m), len(m), m))
            self.table |= {m: best for m in members if m not in (best, "")}
        self.shapes = {x: members for members in across_scripts() for x in members}
        self.weight = Counter()
        for ch, n in counts.items():
            if script(ch):
                self.weight[script(ch)] += n
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _used(self, member: str) -> int:
        return min((self.counts.get(c, 0) for c in member), default=0)

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for k, v in self.table.items():
                self._automaton.add_word(k, (len(k), v))
            self._automaton.make_automaton()
        return self._automaton

    def rewrite(self, text: str | None) -> str | None:
        if not text or text.isascii():
            return text
        out, at = [], 0
        for end, (length, form) in self.automaton().iter_long(text):
            out += [text[at : end + 1 - length], form]
            at = end + 1
        once = "".join(out) + text[at:]
        once = "".join(self.word(w) if not w.isascii() and w[:1].isalpha() else w for w in re.split(r"([^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*)", once))
        return once if once == text else self.rewrite(once)

    def word(self, w: str) -> str:
        scripts = {script(c) for c in w} - {""}
        if len(scripts) < 2:
            return w
        own = {script(c) for c in w if c not in self.shapes} & scripts
        target = max(own or scripts, key=lambda s: (self.weight[s], s == "LATIN"))
        pick = lambda c: next((m for m in sorted(self.shapes.get(c, ()), key=lambda m: (-self.counts.get(m, 0), m)) if script(m) == target), c)
        return "".join(c if script(c) in ("", target) else pick(c) for c in w)


def count_characters(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Code point -> occurrences in ``columns``; at most as many as Unicode has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for b in batches:
            for c in b.columns:
                text = "".join(filter(None, c.to_pylist()))
                total += np.bincount(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cp", "n"])

    rows = df.select(*columns).mapInArrow(run, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    return {chr(r["cp"]): r["n"] for r in rows}


def consistent_forms(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, field, value, form): the values of ``columns`` that their consistent form changes."""
    rewriter = Rewriter(count_characters(df, columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [rewriter.rewrite(v) for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forms, pa.string())], names=["id", "field", "value", "form"])

    values = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    odd = df.select(F.col(id_col).alias("id"), values).filter(F.col("value").isNotNull() & ~F.col("value").rlike(PLAIN))
    out = odd.mapInArrow(run, f"id {dict(odd.dtypes)['id']}, field string, value string, form string")
    return out.filter("form <> value").withColumnRenamed("id", id_col)
