"""Matching company records across sources without keys, by a deterministic rule cascade.

Records are reduced to the forms of their names (country, numbers, core words). The
cascade runs over ever weaker combinations of attributes, each an exact join:
 0. the form itself,
 1. spellings of one record (its name, stored normal form and aliases), and words
    parted or joined differently,
 2. country, numbers, trade, all core words but one and an end of that; of a name of
    one word, the word with a letter deleted,
 3. as 2 without the trade,
 4. country, numbers, trade, an end of one word and an end of the other (both ends, if
    there are several others).
Names may have any number of core words. Pass 1 makes components, as all its edges are
certain; its best supported form (most records under it, then the greater hash) stands
for a component. In each later pass, every component not yet resolved joins the best
supported one that shares a key and is better supported than itself; those resolved so
far are kept out by an anti join. As support only rises along the joins, they make trees,
which pointer doubling collapses.

Each rule's precision is estimated where identifiers tell: both forms of a join carry
usable LEIs, or usable QIDs; it is right if one agrees and wrong if none does. Rule 0 is
judged by the forms with two or more known identifiers of a kind, right if they are one.
It is smoothed as (right + 1) / (known + 2); a rule under ``least`` is dropped. As a
company may hold several identifiers, these figures are lower bounds. The confidence of a
match is the lowest precision on its way.

Scale: support and the best form of a key are partial aggregates, so a name borne by
a third of all rows is one form with a count; nothing is gathered per key. Adaptive
execution hashes joins only where their partitions are small.

Defined results: records without a usable name or source match nothing; sources are
compared without case and outer blanks; repeated rows of one source don't match each
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.functions.identifiers import source_key, with_usable_ids
from kinspark.llm.consolidate import components
from kinspark.llm.names import countries_of_lost, spellings
from kinspark.llm.variants import END, SHORT, SINGLE, cuts, pairs_of_words, together
from kinspark.session import hash_small_partitions, materialize, release, shuffles_removed

MAX_DEPTH = 32


def _ends(c: str, n: int) -> list[Column]:
    return [F.substring(c, 1, n), F.right(c, F.lit(n))]


def _key(rule: int, *parts: Column | str) -> Column:
    return F.xxhash64(F.lit(rule), "base", *parts)


def key_rules() -> dict[int, tuple[Column, list[Column]]]:
    """rule -> (condition, keys) over rows of two parts; keys that don't apply are null."""
    several, both, traded = F.col("y") != "", F.col("both"), F.col("trade") != 0
    sides = [("y", "x", several, 0), ("x", "y", both, 2)]
    ends = [(w, e, i + k, when) for w, o, when, k in sides for i, e in enumerate(_ends(o, END))]
    two_ends = [(a, b, i, j) for i, a in enumerate(_ends("x", SHORT)) for j, b in enumerate(_ends("y", SHORT))]
    return {
        2: (traded & several, [F.when(when, _key(2, F.lit(i), w, e, "trade")) for w, e, i, when in ends]),
        3: (several, [F.when(when, _key(3, F.lit(i), w, e)) for w, e, i, when in ends]),
        # of more than two words, y is several: both its ends must agree
        4: (traded & several, [F.when(both, _key(4, F.lit(2 * i + j), a, b, "trade")).when(F.lit(j == 0), _key(4, F.lit(4 + i), a, *_ends("y", SHORT), "trade")) for a, b, i, j in two_ends]),
    }


def single_keys(two: DataFrame) -> DataFrame:
    """(form, rank, key): the keys of rule 2 of names of one word, all ways to leave out a letter of it."""
    less = F.expr("explode(concat(array(x), transform(sequence(1, length(x)), i -> concat(substring(x, 1, i - 1), substring(x, i + 1)))))")
    return two.filter((F.col("y") == "") & (F.length("x") >= SINGLE)).select("form", "rank", "base", "trade", less.alias("part")).select("form", "rank", _key(2, F.lit(-1), "part", "trade").alias("key"))


def _rank(form: str) -> Column:
    """A number that orders forms by support, then by hash; long, so that its maximum is kept in a hash aggregate."""
    return F.shiftleft(F.least("support", F.lit(2**20 - 1)).cast("long"), 42).bitwiseOR(F.col(form).bitwiseAND(F.lit(2**42 - 1)))


def cascade(spelled: DataFrame) -> list[DataFrame]:
    """(form, parent, rule): every resolved form, the form it joined, and by which rule; a written table for each rule."""
    # a form without a country or only of aliases never leads another: it could not join further
    counted = spelled.groupBy("form").agg(F.count_if((F.col("country") != "") & (F.col("kind") < 2)).alias("support"))
    counted = materialize(counted.select("form", _rank("form").alias("rank")), "support")
    two = materialize(pairs_of_words(spelled.filter("kind < 2")).filter("NOT joined").drop("joined"), "twowords")
    labels = components(together(spelled).unionByName(countries_of_lost(spelled)).unionByName(cuts(spelled, two)))
    # the best supported form of a component stands for all of it
    ranked = counted.join(labels.withColumnsRenamed({"vertex": "form", "component": "whole"}), "form", "left")
    leads = ranked.filter("whole IS NOT NULL").groupBy("whole").agg(F.max_by("form", "rank").alias("lead"), F.max("rank").alias("top"))
    led = ranked.join(leads, "whole", "left").select("form", F.coalesce("lead", "form").alias("lead"), F.coalesce("top", "rank").alias("rank"))
    led = materialize(led, "led")
    found = [led.filter("form <> lead").select("form", F.col("lead").alias("parent"), F.lit(1).alias("rule"))]
    found[0]._kinspark_path = led._kinspark_path
    units = materialize(two.join(led, "form").drop("form", "plain").withColumnRenamed("lead", "form"), "units")
    for old in (counted, labels, two):
        release(old)
    two = units
    for rule, (condition, keys) in key_rules().items():

        def keyed(rows: DataFrame, rule: int = rule, condition: Column = condition, keys: list[Column] = keys) -> DataFrame:
            out = rows.filter(condition).select("form", "rank", F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL")
            return out.unionByName(single_keys(rows)) if rule == 2 else out

        best = keyed(two).groupBy("key").agg(F.max_by("form", "rank").alias("up"), F.max("rank").alias("top"), F.min("rank").alias("low")).filter("low < top")
        left = two
        if len(found) > 1:
            resolved = reduce(DataFrame.unionByName, found[1:]).select("form")
            left = left.join(resolved, "form", "left_anti")
        joined = keyed(left).join(best, "key").filter("top > rank")
        found.append(materialize(joined.groupBy("form").agg(F.max_by("up", "top").alias("parent")).select("form", "parent", F.lit(rule).alias("rule")), f"pass{rule}"))
    release(two)
    return found


def identifiers_of_forms(facts: DataFrame) -> DataFrame:
    """(form, lei, lei_high, qid, qid_high, lei_n, qid_n): the smallest and greatest identifiers of the records under a form, and how many records have one."""
    known = facts.filter("lei IS NOT NULL OR qid IS NOT NULL").groupBy("form")
    return known.agg(*[f(c).alias(n) for c in ("lei", "qid") for f, n in ((F.min, c), (F.max, f"{c}_high"), (F.count, f"{c}_n"))])


def rule_precision(links: DataFrame, labels: DataFrame) -> dict[int, float]:
    """rule -> smoothed share of the joins, among those whose identifiers are known, in which one agrees."""
    side = lambda k: labels.select(F.col("form").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("lei", "lei_high", "qid", "qid_high")])
    both = links.join(side("form"), "form").join(side("parent"), "parent")
    agree = lambda c: reduce(Column.__or__, [F.col(f"{p}_form") == F.col(f"{q}_parent") for p in (c, f"{c}_high") for q in (c, f"{c}_high")])
    known, right = _known_right({c: (F.col(f"{c}_form").isNotNull() & F.col(f"{c}_parent").isNotNull(), agree(c)) for c in ("lei", "qid")})
    counted = both.groupBy("rule").agg(F.count_if(right).alias("r"), F.count_if(known).alias("n"))
    known, right = _known_right({c: (F.col(f"{c}_n") > 1, F.col(c) == F.col(f"{c}_high")) for c in ("lei", "qid")})
    alike = labels.agg(F.lit(0).alias("rule"), F.count_if(right).alias("r"), F.count_if(known).alias("n"))
    with shuffles_removed(links.sparkSession):
        shares = {r["rule"]: (r["r"] + 1) / (r["n"] + 2) for r in counted.unionByName(alike).collect()}  # one row a rule
    return {rule: shares.get(rule, 0.5) for rule in (0, 1, *key_rules())}


def _known_right(kinds: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """Whether an identifier of some kind is known, and whether a known one agrees."""
    known = reduce(Column.__or__, [k for k, _ in kinds.values()])
    right = reduce(Column.__or__, [k & F.coalesce(a, F.lit(False)) for k, a in kinds.values()])
    return known, right


def roots(links: DataFrame) -> DataFrame:
    """(form, root, confidence) of every joined form, by pointer doubling."""
    tree = materialize(links.select("form", F.col("parent").alias("root"), "confidence", F.lit(False).alias("done")), "tree")
    for _ in range(MAX_DEPTH):
        up = tree.select(F.col("form").alias("root"), F.col("root").alias("top"), F.col("confidence").alias("upper"), F.col("done").alias("above"))
        # done: what is above joined nothing, or was done
        step = materialize(
            tree.join(up, "root", "left").select("form", F.coalesce("top", "root").alias("root"), F.least("confidence", F.coalesce("upper", "confidence")).alias("confidence"), F.coalesce("above", F.lit(True)).alias("done")),
            "tree",
        )
        release(tree)
        tree = step
        if tree.filter("NOT done").isEmpty():
            out = tree.drop("done")
            out._kinspark_path = tree._kinspark_path
            return out
    raise RuntimeError("trees did not collapse")


def placed_records(companies: DataFrame, country_aliases: DataFrame, least: float = 0.5, generic: Iterable[str] = ()) -> DataFrame:
    """(rec_id, source, lei, qid, root, confidence): the company of every record with a usable name and a source."""
    hash_small_partitions(companies.sparkSession)
    read = with_usable_ids(companies.select("rec_id", "country", "city", "name", "name_norm", "aliases", "lei", "wikidata_qid", source_key(F.col("source")).alias("key")))
    empty = F.xxhash64(F.lit(None).cast("string"))  # what the hash of null is
    keep = {k: F.nullif(F.xxhash64(c), empty) for k, c in (("source", "key"), ("lei", "usable_lei"), ("qid", "usable_qid"))}
    spelled = spellings(read.select("rec_id", "country", "city", "name", "name_norm", "aliases", *[c.alias(f"{k}_number") for k, c in keep.items()]), country_aliases, {f"{k}_number": F.col(f"{k}_number") for k in keep}, generic)
    facts = spelled.withColumnsRenamed({f"{k}_number": k for k in keep}).filter("first").select("rec_id", "form", "source", "lei", "qid")
    passes = cascade(spelled)
    links = reduce(DataFrame.unionByName, passes)
    labels = materialize(identifiers_of_forms(facts), "labels")
    precision = rule_precision(links, labels)
    release(labels)
    confidence = F.element_at(F.create_map(*[F.lit(x) for pair in precision.items() for x in pair]), F.col("rule"))
    tree = roots(links.withColumn("confidence", confidence).filter(F.col("confidence") >= least))
    for old in passes:
        release(old)
    found = facts.filter("source IS NOT NULL").join(tree, "form", "left")
    rows = found.select("rec_id", "source", "lei", "qid", F.coalesce("root", "form").alias("root"), F.least(F.coalesce("confidence", F.lit(1.0)), F.lit(precision[0])).alias("confidence"))
    out = materialize(rows, "placed")
    release(spelled)
    release(tree)
    return out


def match_sources(companies: DataFrame, country_aliases: DataFrame, least: float = 0.5, generic: Iterable[str] = ()) -> DataFrame:
    """(rec_id_a, rec_id_b, confidence): the same company in two sources, without a common identifier."""
    rows = placed_records(companies, country_aliases, least, generic)
    a = rows.select("root", *[F.col(c).alias(f"{c}_a") for c in ("rec_id", "source", "lei", "qid", "confidence")])
    b = rows.select("root", *[F.col(c).alias(f"{c}_b") for c in ("rec_id", "source", "lei", "qid", "confidence")])
    apart = "rec_id_a < rec_id_b AND source_a <> source_b AND NOT coalesce(lei_a = lei_b, false) AND NOT coalesce(qid_a = qid_b, false)"
    return a.join(b, "root").filter(apart).select("rec_id_a", "rec_id_b", F.least("confidence_a", "confidence_b").alias("confidence"))


def source_members(companies: DataFrame, country_aliases: DataFrame, least: float = 0.5, generic: Iterable[str] = ()) -> DataFrame:
    """(rec_id, company, confidence, sources): the company of every record and the number of sources it is in; grows with the records, not with their pairs."""
    rows = placed_records(companies, country_aliases, least, generic)
    spread = rows.select("root", "source").distinct().groupBy("root").agg(F.count("*").alias("sources"))
    return rows.join(spread, "root").select("rec_id", F.col("root").alias("company"), "confidence", "sources")
