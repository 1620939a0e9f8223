"""Variant spellings of names typed by people, linked by a symmetric-delete index.

The spellings of all records are reduced to their distinct forms (country, numbers,
core words). A form of any number of words is shown in rows (x, y): two words as they
are; of more words each in turn as x and the others, sorted, as y, and so with two
neighbours joined; a form of several trades has these rows for each. Rows are put into blocks that share y (of two words also x), or the trade and an end of y.
Within a block, every row is entered in an index under its other word with no or one
letter deleted: any two words one slip apart (a letter wrong, missing, doubled or
swapped with its neighbour) meet under some entry, and a word cut short, or mistyped
more than once, meets its whole form under its first or last letters. Rows that meet are
aligned by the assignment with the least distance; a link stands if one part agrees and
the other is a slip or an abbreviation of it, or, where the words of trade agree, up to
three edits away from it, or if both are slips and the words of trade agree. An initial
stands for a word of its letter where only one company has such a word beside the others.
Forms of one word carry their trade and meet under its beginning or end; they are linked
by one slip from SINGLE letters on. Forms of other than two words (a blank lost or added)
meet two-word forms by all their cuts.
Spellings of one record belong together. Linked forms make companies by Boruvka
consolidation.

Scale: a hot name is one form however many records bear it. Generic words are set aside
before blocking. Forms of an index entry are compared until they are connected. Blocks of
more than HOT rows are found first and parted in Spark, a row for each entry, so that a
task holds the rows of an entry and no index of a block; nothing is left out by that.

Defined results: records without a usable spelling match nothing; a record whose
country is unknown and cannot be told from its city belongs to the country that all
records with its spelling agree on, else it only matches records alike; repeated rows
match each other where their names differ; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.consolidate import components
from kinspark.llm.edits import deletions_of, slips
from kinspark.llm.names import countries_of_lost, form_of, spellings
from kinspark.session import materialize, release

#: Letters of a word's beginning or end that make a block.
END = 3
#: Letters that an abbreviated word keeps at least.
SHORT = 4
#: Letters beyond which a word is entered by its ends, of which a slip leaves one whole, instead of its deletions.
LONG = 64
#: Letters of a name of one word from which on it may have a slip.
SINGLE = 6
#: Rows of an index entry beyond which it is parted by the other word.
MANY = 32
#: Rows of a block beyond which Spark parts it; a task holds about 10 kB for each.
HOT = 20_000
#: Failed comparisons that a block remembers at once.
MEMO = 100_000


def abbreviates(a: str, b: str) -> bool:
    """Whether one of the words is an initial or a beginning of the other, of SHORT letters or more."""
    a, b = sorted((a, b), key=len)
    return b.startswith(a) and (len(a) >= SHORT or len(a) == 1)


def near(a: str, b: str, same_trade: bool) -> bool:
    """Whether a word is a slip or an abbreviation of another, or, in the same trade, a few edits away."""
    if slips(a, b, 1) <= 1 or abbreviates(a, b):
        return True
    shorter = min(len(a), len(b))
    return same_trade and shorter >= 6 and slips(a, b, 3) <= (3 if shorter >= 8 else 2)


def aligned(xa: str, ya: str, xb: str, yb: str, same_trade: bool) -> bool:
    """Whether an assignment of the words makes the names variants of each other."""
    if not ya or not yb:
        return ya == yb and (xa == xb or (min(len(xa), len(xb)) >= SINGLE and slips(xa, xb, 1) <= 1))
    for p, q, r, s in ((xa, xb, ya, yb), (xa, yb, ya, xb)):
        if p == q:
            if near(r, s, same_trade):
                return True
        elif r == s:
            if near(p, q, same_trade):
                return True
        elif same_trade and slips(p, q, 1) <= 1 and slips(r, s, 1) <= 1:
            return True
    return False


def pairs_of_words(spelled: DataFrame) -> DataFrame:
    """(form, base, x, y, trade, plain, both, joined): the distinct forms in rows of two parts; base stands for country and numbers.

    plain: the form has two words. both: x and y change places, and x + y is the
    smaller order; else y is all of the name but x. Of one word, y is empty.
    joined: x is two neighbours in one, as a blank may have been put into a word.
    A form has a row for each trade that it is written with, and aliases are forms like names.
    """
    some = spelled.select("form", base_of().alias("base"), "n", "words", "trade").distinct()
    two = some.filter("n = 2").select("form", "base", F.split_part("words", F.lit(" "), F.lit(1)).alias("x"), F.split_part("words", F.lit(" "), F.lit(2)).alias("y"), "trade", F.lit(True).alias("plain"), F.lit(True).alias("both"), F.lit(False).alias("joined"))
    one = some.filter("n = 1").select("form", "base", F.col("words").alias("x"), F.lit("").alias("y"), "trade", F.lit(False).alias("plain"), F.lit(False).alias("both"), F.lit(False).alias("joined"))
    more = some.filter("n > 2").select("form", "base", "trade", "n", F.split("words", " ").alias("w"))
    rest = "array_join(array_sort(filter({w}, (v, j) -> {out})), '')"
    ways = ", ".join([
        f"transform(w, (u, i) -> struct(u AS p, {rest.format(w='w', out='j <> i')} AS q, false AS joined))",
        f"transform(slice(w, 2, n), (u, i) -> struct(w[i] || u AS p, {rest.format(w='w', out='j <> i AND j <> i + 1')} AS q, true AS joined))",
    ])
    shown = more.select("form", "base", "trade", "n", F.inline(F.expr(f"concat({ways})")), F.lit(False).alias("plain"))
    # of three words, joining two leaves two
    both = (F.col("n") == 3) & F.col("joined")
    straight = ~both | (F.concat("p", "q") <= F.concat("q", "p"))
    turned = [F.when(straight, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("p", "q", "x"), ("q", "p", "y"))]
    return two.unionByName(one).unionByName(shown.select("form", "base", *turned, "trade", "plain", both.alias("both"), "joined"))


def cuts(spelled: DataFrame, two: DataFrame) -> DataFrame:
    """(a, b): forms of one, three or more words and the forms of two words they may be."""
    odd = spelled.filter("n <> 2").select("form", base_of().alias("base"), F.replace("words", F.lit(" "), F.lit("")).alias("whole")).distinct()
    places = F.sequence(F.lit(END), F.length("whole") - END)
    at = odd.filter(F.length("whole") >= 2 * END).select("form", "base", "whole", F.explode(places).alias("i"))
    left, right = F.expr("substring(whole, 1, i)"), F.expr("substring(whole, i + 1)")
    guessed = at.select(F.col("form").alias("a"), F.xxhash64("base", F.least(F.concat(left, right), F.concat(right, left))).alias("key"))
    plain = two.filter("plain").select(F.col("form").alias("b"), F.xxhash64("base", F.concat("x", "y")).alias("key"))
    return guessed.join(plain, "key").filter("a <> b").select("a", "b")


def base_of() -> Column:
    """The number that stands for the country and the number of a name."""
    return F.xxhash64("country", "num")


def together(spelled: DataFrame) -> DataFrame:
    """(a, b): the first form of a record and its other forms; forms of several records several times."""
    lead = form_of("lead")
    return spelled.filter(lead != F.col("form")).select(lead.alias("a"), F.col("form").alias("b"))


def _entries(word: str, ends: bool) -> set:
    """What a word is entered under: its deletions and, where wanted or the word is too long for them, its ends."""
    whole = {word} if len(word) > LONG else deletions_of(word)
    return whole | ({("short", word[:SHORT]), ("end", word[-SHORT:])} if ends or len(word) > LONG else set())


def _meet(rows: list[tuple]) -> bool:
    """Whether the two rows of a block have an entry in common."""
    (_, u, xa, ya, _), (_, v, xb, yb, _) = rows
    same = (ya if u == xa else xa) == (yb if v == xb else xb)
    return not _entries(u, same).isdisjoint(_entries(v, same))


def _pairs_of_block(rows: list[tuple], part: bool = False) -> Iterator[tuple[int, int]]:
    """Aligned pairs among the rows (form, word, x, y, trade) of a block that connect all rows which are aligned and meet under an entry.

    An entry keeps its rows in groups that are connected already. A row is compared with
    every group until one of the group's rows is aligned with it. Where the other words of
    a block differ, only slips in both words are sought, and an entry of more than MANY
    rows is parted by the entries of the other word. A ``part`` of a block is the rows
    of one entry already, so that they need no index of others.
    """
    if len(rows) == 2:
        (a, u, xa, ya, s), (b, v, xb, yb, t) = rows
        if a != b and ((xa, ya, s) == (xb, yb, t) or (aligned(xa, ya, xb, yb, s != 0 and s == t) and _meet(rows))):
            yield a, b
        return
    others = [y if word == x else x for _, word, x, y, _ in rows]
    several = len(set(others)) > 1
    index: dict = {}
    parted: set = set()
    first: dict = {}
    root = list(range(len(rows)))
    apart = set()

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def fits(i: int, j: int) -> bool:
        if (i, j) in apart:
            return False
        p, q = rows[i], rows[j]
        if p[0] == q[0] or aligned(p[2], p[3], q[2], q[3], p[4] != 0 and p[4] == q[4]):
            return True
        if len(apart) >= MEMO:
            apart.clear()
        apart.add((i, j))
        return False

    def met(i: int, entry) -> list[tuple[int, int]]:
        groups, own, rest, found = index.get(entry), None, [], []
        if groups is None:
            index[entry] = [[i]]
            return found
        for group in groups:
            if top(group[0]) != top(i):
                j = next((j for j in group if fits(i, j)), None)
                if j is None:
                    rest.append(group)
                    continue
                root[top(i)] = top(j)
                if rows[i][0] != rows[j][0]:
                    found.append((rows[i][0], rows[j][0]))
            if own is None:
                own = group
                own.append(i)
            else:
                own.extend(group)
        index[entry] = [own or [i], *rest]
        return found

    for i, (form, word, x, y, trade) in enumerate(rows):
        same = first.setdefault((x, y, trade), i)
        if same != i:  # another form of the same words and trade
            if form != rows[same][0]:
                yield form, rows[same][0]
            root[top(i)] = top(same)
            continue
        for entry in ("",) if part else _entries(word, not several):
            if entry in parted:
                for end in _entries(others[i], False):
                    yield from met(i, (entry, end))
                continue
            yield from met(i, entry)
            if several and sum(map(len, index[entry])) > MANY:
                parted.add(entry)
                for j in sorted(j for group in index.pop(entry) for j in group):
                    for end in _entries(others[j], False):
                        yield from met(j, (entry, end))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of aligned forms; the rows of a block follow each other, also from batch to batch."""
    block, waiting, part = None, [], False

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (min, max)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column(0).to_numpy()
        # rows alone in their block are left out; at the ends of a batch they may go on
        new = np.concatenate(([True], blocks[1:] != blocks[:-1], [True]))
        alone = new[1:] & new[:-1]
        alone[0] = alone[-1] = False
        kept = batch.filter(pa.array(~alone)) if alone.any() else batch
        blocks = kept.column(0).to_numpy()
        rows, parts = list(zip(*[c.to_pylist() for c in kept.columns[1:-1]], strict=True)), kept.column(kept.num_columns - 1)
        starts = np.concatenate(([0], np.nonzero(np.diff(blocks))[0] + 1)).tolist()
        found: list[tuple[int, int]] = []
        for start, stop in zip(starts, [*starts[1:], len(blocks)], strict=True):
            if blocks[start] != block:
                if len(waiting) > 1:
                    found += _pairs_of_block(waiting, part)
                block, waiting, part = blocks[start], [], parts[start].as_py()
            waiting += rows[start:stop]
        yield out(found)
    if len(waiting) > 1:
        yield out(list(_pairs_of_block(waiting, part)))


def links(two: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): forms that are variants of each other, some several times.

    The symmetric-delete index is kept by block: the forms that share a word, and those
    that share the trade and an end of a word. A block's index maps every deletion of
    the other word to all forms that have it, in groups that are connected already.
    """
    base = F.col("base")
    traded = F.col("trade") != 0
    block = lambda when, word, kind, *parts: F.struct(F.when(when, F.xxhash64(base, F.lit(kind), *parts)).alias("block"), F.col(word).alias("word"))
    start, end = (lambda c: F.substring(c, 1, END)), (lambda c: F.right(c, F.lit(END)))  # of words of seven letters a slip leaves one of them whole
    blocks = F.array(
        block(F.col("y") != "", "x", 1, "y"),
        block(F.col("both"), "y", 1, "x"),
        block(traded & (F.col("y") != ""), "x", 3, "trade", start(F.col("y"))),
        block(traded & (F.col("y") != ""), "x", 4, "trade", end(F.col("y"))),
        block(F.col("y") == "", "x", 5, "trade", start(F.col("x"))),
        block(F.col("y") == "", "x", 6, "trade", end(F.col("x"))),
    )
    rows = two.select("form", "x", "y", "trade", F.inline(blocks)).filter("block IS NOT NULL").select("block", "form", "word", "x", "y", "trade")
    # a block of more rows than that has more than a task's share of them in some task
    share = hot // max(rows.rdd.getNumPartitions(), 1)
    large = materialize(rows.select("block").mapInArrow(_common(share), "block long").distinct(), "hotblocks")
    whole = rows.withColumn("part", F.lit(False))
    if not large.isEmpty():
        # rows that can be aligned have an entry in common
        parted = rows.join(large, "block", "left_semi").mapInArrow(_spread, "block long, form long, word string, x string, y string, trade int")
        whole = whole.join(large, "block", "left_anti").unionByName(parted.withColumn("part", F.lit(True)))
    else:
        release(large)
    return whole.repartition("block").sortWithinPartitions("block", "form").mapInArrow(_link, "a long, b long")


def _common(share: int):
    """The blocks of which a task has more than ``share`` rows; it holds a number a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(blocks[n > share])], names=["block"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of large blocks, one for each entry of their word."""
    for batch in batches:
        out = []
        for block, form, word, x, y, trade in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            out += [(_number(block, e), form, word, x, y, trade) for e in _entries(word, True)]
        names = ["block", "form", "word", "x", "y", "trade"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], batch.column(i).type) for i in range(len(names))], names=names)


def _number(*parts) -> int:
    """A number of 64 bits that stands for the parts, alike in all processes."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big", signed=True)


def with_initials(two: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` with the forms whose one word is an initial under the company that it stands for.

    An initial stands for a word if the forms with the same other words, and a word of
    that letter, are of one company.
    """
    turned = two.filter("both").select("form", "base", F.col("y").alias("x"), F.col("x").alias("y"))
    parts = two.filter("y <> ''").select("form", "base", "x", "y").unionByName(turned)
    parts = parts.select("form", (F.length("x") == 1).alias("initial"), F.xxhash64("base", "y", F.substring("x", 1, 1)).alias("key"))
    asked = materialize(parts.filter("initial").select("form", "key").distinct(), "initials")
    if asked.isEmpty():
        release(asked)
        return labels
    vertex = lambda df: df.withColumnRenamed("form", "vertex").join(labels, "vertex", "left").withColumn("company", F.coalesce("component", "vertex"))
    known = vertex(parts.filter("NOT initial").join(asked.select("key").distinct(), "key", "left_semi"))
    one = known.groupBy("key").agg(F.min("company").alias("company"), F.max("company").alias("high")).filter("company = high").select("key", F.col("company").alias("b"))
    merged = components(vertex(asked).join(one, "key").filter("company <> b").select(F.col("company").alias("a"), "b"))
    moved = merged.select(F.col("vertex").alias("component"), F.col("component").alias("whole"))
    out = labels.join(moved, "component", "left").select("vertex", F.coalesce("whole", "component").alias("component"))
    new = merged.join(labels, "vertex", "left_anti")  # forms that nothing tied before
    out = materialize(out.unionByName(new.select("vertex", "component")), "labels")
    for old in (asked, labels, merged):
        release(old)
    return out


def companies_by_spelling(companies: DataFrame, country_aliases: DataFrame, generic: Iterable[str] = (), hot: int = HOT) -> DataFrame:
    """(rec_id, company, written): records under the same company number are variants of one name.

    written is the hash of the name as written; a null name counts as a string of its own.
    ``generic`` are words known to be generic besides those learnt from the names.
    """
    spelled = spellings(companies, country_aliases, {"written": F.xxhash64("name", F.col("name").isNull())}, generic)
    two = materialize(pairs_of_words(spelled), "twowords")
    edges = together(spelled).unionByName(countries_of_lost(spelled)).unionByName(cuts(spelled, two)).unionByName(links(two, hot))
    labels = with_initials(two, components(edges))
    release(two)
    own = spelled.filter("first").select("rec_id", F.col("form").alias("vertex"), "written")
    out = materialize(own.join(labels, "vertex", "left").select("rec_id", F.coalesce("component", "vertex").alias("company"), "written"), "companies")
    release(spelled)
    release(labels)
    return out


def variant_members(companies: DataFrame, country_aliases: DataFrame, generic: Iterable[str] = ()) -> DataFrame:
    """(rec_id, company, links): the company of every record with a usable spelling, and how many of its records are written differently.

    The result grows with the records, not with their pairs.
    """
    of = companies_by_spelling(companies, country_aliases, generic)
    spelled = of.groupBy("company", "written").count()
    all_of = spelled.groupBy("company").agg(F.sum("count").alias("all"))
    links = spelled.join(all_of, "company").select("company", "written", (F.col("all") - F.col("count")).alias("links"))
    return of.join(links, ["company", "written"]).select("rec_id", "company", "links")


def variant_pairs(companies: DataFrame, country_aliases: DataFrame, generic: Iterable[str] = (), hot: int = HOT) -> DataFrame:
    """(rec_id_a, rec_id_b): records of one company whose names are different strings."""
    rows = companies_by_spelling(companies, country_aliases, generic, hot)
    a, b = (rows.select("company", F.col("rec_id").alias(f"rec_id_{k}"), F.col("written").alias(f"written_{k}")) for k in "ab")
    return a.join(b, "company").filter("rec_id_a < rec_id_b AND written_a <> written_b").select("rec_id_a", "rec_id_b")
