"""Mentions of metals in texts: chemical forms, trade specifications, names, symbols, purities, pairs."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element symbols by family.
SYMBOLS = {
    "precious": "Au Ag", "pgm": "Pt Pd Rh Ru Ir Os", "base": "Cu Zn Pb Al Ni Sn Fe", "battery": "Li Co Mn C",
    "specialty": "W Mo V Ti Ta Nb Zr Hf Re In Ga Ge Te Se Bi Sb Cd Cr Be Mg Ca Sr Ba U Th",
    "ree": "La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Y Sc",
}
FAMILY = {s: family for family, symbols in SYMBOLS.items() for s in symbols.split()}
#: Fixed values: (pattern, query, category) of chemical forms, in order of preference.
FORMS = (
    (r"lithium\s+carbonate", "lithium carbonate", "battery"), (r"Li2CO3", "lithium carbonate", "battery"),
    (r"lithium\s+hydroxide", "lithium hydroxide", "battery"), (r"LiOH", "lithium hydroxide", "battery"),
    (r"ferro[\s-]?chrome", "ferrochrome", "ferroalloy"), (r"ferro[\s-]?chromium", "ferrochrome", "ferroalloy"), (r"FeCr", "ferrochrome", "ferroalloy"),
    (r"ferro[\s-]?manganese", "ferromanganese", "ferroalloy"), (r"FeMn", "ferromanganese", "ferroalloy"),
    (r"ferro[\s-]?vanadium", "ferrovanadium", "ferroalloy"), (r"FeV", "ferrovanadium", "ferroalloy"),
    (r"ferro[\s-]?tungsten", "ferrotungsten", "ferroalloy"), (r"FeW", "ferrotungsten", "ferroalloy"),
    (r"ferro[\s-]?molybdenum", "ferromolybdenum", "ferroalloy"), (r"ferro[\s-]?moly", "ferromolybdenum", "ferroalloy"), (r"FeMo", "ferromolybdenum", "ferroalloy"),
    (r"cobalt\s+sulfate", "cobalt sulfate", "battery"), (r"CoSO4", "cobalt sulfate", "battery"),
    (r"nickel\s+sulfate", "nickel sulfate", "battery"), (r"NiSO4", "nickel sulfate", "battery"),
    (r"NdPr", "neodymium-praseodymium", "ree"), (r"Nd-Pr", "neodymium-praseodymium", "ree"), (r"didymium", "neodymium-praseodymium", "ree"),
    (r"natural\s+graphite", "graphite (natural)", "battery"), (r"synthetic\s+graphite", "graphite (synthetic)", "battery"),
    (r"artificial\s+graphite", "graphite (synthetic)", "battery"), (r"spherical\s+graphite", "graphite (natural)", "battery"),
    (r"alumina", "aluminum oxide", "base"), (r"Al2O3", "aluminum oxide", "base"), (r"tungsten\s+oxide", "tungsten oxide", "specialty"),
    (r"WO3", "tungsten oxide", "specialty"), (r"vanadium\s+pentoxide", "vanadium", "specialty"), (r"V2O5", "vanadium", "specialty"),
)
#: Fixed values: (pattern, query, category) of trade specifications.
TRADE = (
    (r"APT\s*(?:\d+(?:\.\d+)?%?)?", "apt", "specialty"), (r"ammonium\s+paratungstate", "apt", "specialty"), (r"P1020", "aluminum", "base"),
    (r"A380", "aluminum", "base"), (r"SHG\s+zinc", "zinc", "base"), (r"special\s+high\s+grade", "zinc", "base"), (r"Grade\s+A\s+copper", "copper", "base"),
    (r"cathode\s+copper", "copper", "base"), (r"battery[\s-]grade", "battery_grade", "battery"), (r"technical[\s-]grade", "technical_grade", None),
)
#: Names of metals by family, and names that stand for another.
NAMES = {
    "specialty": "tungsten molybdenum vanadium tantalum niobium rhenium indium gallium germanium tellurium selenium bismuth antimony cadmium titanium zirconium hafnium",
    "pgm": "platinum palladium rhodium ruthenium iridium osmium", "precious": "gold silver", "base": "copper zinc lead aluminum tin iron",
    "battery": "nickel cobalt lithium graphite", "ferroalloy": "chromium manganese",
}
SAME_NAME = {"wolfram": ("tungsten", "specialty"), "columbium": ("niobium", "specialty"), "quicksilver": ("mercury", "specialty"), "aluminium": ("aluminum", "base")}
NAME_OF = SAME_NAME | {n: (n, family) for family, names in NAMES.items() for n in names.split()}
#: Words that tell the category of a text, the first that occurs counts.
LADDER = (
    ("battery", ("battery", "lithium-ion", "ev", "cathode", "anode")), ("pgm", ("pgm", "platinum group", "autocatalyst")),
    ("precious", ("precious", "bullion", "jewelry")), ("ferroalloy", ("steel", "ferroalloy", "ferro-")),
    ("ree", ("rare earth", "ree", "magnet", "lanthanide")), ("base", ("base metal", "lme", "concentrate")),
    ("specialty", ("specialty", "minor metal", "technology metal")),
)
#: Longest first, so that an alternation takes the whole symbol or name.
SYMBOL = "(?:" + "|".join(sorted(FAMILY, key=lambda s: (-len(s), s))) + ")"
NAME = "(?:" + "|".join(sorted(NAME_OF, key=lambda s: (-len(s), s))) + ")"
PERCENT = r"\d+(?:\.\d+)?%"
FLAGS = re.IGNORECASE
STRETCH = 64


@dataclass(frozen=True)
class Rule:
    """A pattern with the hint of its mentions; query and category are told from the match.

    stem is a literal that every match has, in lower case; texts without it are passed over.
    """

    pattern: re.Pattern
    stem: str
    hint: str
    query: Callable[[re.Match], str]
    category: Callable[[re.Match], str | None]
    group: int = 0


@lru_cache(maxsize=1)
def literal_rules() -> tuple[Rule, ...]:
    """Chemical forms, then trade specifications, in order of preference."""

    def listed(table: tuple, hint: str) -> list[Rule]:
        return [Rule(re.compile(p, FLAGS), re.match(r"[A-Za-z0-9]+", p)[0].lower(), hint, lambda m, q=q: q, lambda m, c=c: c) for p, q, c in table]

    return (*listed(FORMS, "chemical_form"), *listed(TRADE, "trade_spec"))


@lru_cache(maxsize=4096)
def name_rule(names: tuple[str, ...]) -> Rule:
    """The rule for those of the names that occur in a text."""
    either = "|".join(sorted(names, key=lambda s: (-len(s), s)))
    return Rule(re.compile(rf"\b(?:{either})\b", FLAGS), "", "name", lambda m: NAME_OF[m[0].lower()][0], lambda m: NAME_OF[m[0].lower()][1])


@lru_cache(maxsize=1)
def symbol_rules() -> tuple[Rule, ...]:
    """Combined symbols, symbols by their context, purities."""
    lower = lambda m: m[0].lower()
    capital = "(?=[A-Z])"
    combined = Rule(re.compile(rf"\b{capital}{SYMBOL}(?:[/\-]{SYMBOL})+\b"), "", "symbol_combination", lower, lambda m: None)
    places = (
        ("(", rf"\(({SYMBOL})\)"), ("", rf"[:=]\s*({SYMBOL})\b"), ("%", rf"{PERCENT}\s*({SYMBOL})\b"), ("", rf"\b(?:of|for|with|containing)\s+({SYMBOL})\b"),
        ("", rf"(?:^|[,\s]){capital}({SYMBOL})(?=,|\s+(?:and|or)\s+{SYMBOL})"), ("", rf"\b{capital}({SYMBOL})(?=[.\s,;:!?\)]|$)"),
    )
    single = [Rule(re.compile(p), stem, "symbol", lambda m: m[1].lower(), lambda m: FAMILY[m[1]], 1) for stem, p in places]
    pure = Rule(re.compile(rf"{PERCENT}\s+({NAME}|{SYMBOL})", FLAGS), "%", "purity_spec", lambda m: m[1].lower(), lambda m: None)
    return (combined, *single, pure)


def find_metals(text: str | None) -> list[tuple[int, int, str, str, str | None]]:
    """(start, stop, query, hint, category) in order of place.

    Of overlapping mentions the rule that comes first stays, unless a longer one follows.
    """
    if not text:
        return []
    low = text.lower()
    names = tuple(n for n in NAME_OF if n in low)
    kept: list[tuple[int, int, str, str, str | None]] = []
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)  # kept spans by the stretches of text they touch
    for rule in (*literal_rules(), *([name_rule(names)] if names else []), *symbol_rules()):
        if rule.stem not in low:
            continue
        for m in rule.pattern.finditer(text):
            start, stop = m.span(rule.group)
            stretches = range(start // STRETCH, stop // STRETCH + 1)
            if not any(start < b and stop > a and b - a >= stop - start for k in stretches for a, b in near.get(k, ())):
                kept.append((start, stop, rule.query(m), rule.hint, rule.category(m)))
                for k in stretches:
                    near[k].append((start, stop))
    return sorted(kept, key=lambda k: k[0])


def document_metals(docs: DataFrame, id_col: str, text_col: str, cluster_hint: str | None = None) -> DataFrame:
    """(id, query, start, stop, hint, category, cluster) of every mention; null texts have none.

    Some fifty patterns with a rule of overlaps go over each text; they run over Arrow
    batches, most of them only where a literal that they need occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, q, s, e, h, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, e, q, h, c in find_metals(t)]
            kinds = [b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "query", "start", "stop", "hint", "category"])

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, query string, start int, stop int, hint string, category string")
    return found.withColumn("cluster", F.lit(cluster_hint))


def metal_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, first, second): symbols joined by / or -, in lower case, none used twice."""
    pattern = F.lit(rf"\b({SYMBOL})[/\-]({SYMBOL})\b")
    pair = F.arrays_zip(F.regexp_extract_all(text_col, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(text_col, pattern, F.lit(2)).alias("b"))
    return docs.select(F.col(id_col), F.posexplode(pair).alias("position", "p")).select(id_col, "position", F.lower("p.a").alias("first"), F.lower("p.b").alias("second"))


def text_category(text: Column) -> Column:
    """The category whose words occur in a text, by the ladder; null without any."""
    lower = F.lower(text)
    out = F.lit(None).cast("string")
    for category, words in reversed(LADDER):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(lower, F.lit(w))
        out = F.when(hit, category).otherwise(out)
    return out
