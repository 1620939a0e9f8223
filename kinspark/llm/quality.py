"""Per-document text quality statistics and the text types they point to.

``text_statistics`` gives one row of figures for every document, from whole texts.
Words are counted by their distinct forms: a run of documents is split into words,
the distinct words are judged once, and the judgements are summed per document, all
in columns. ``text_types`` treats thresholds on these figures as noisy labelling
functions: each votes that the type of the text is in a set of types, or that it is
outside of it, or abstains. The accuracies of the functions are learnt by
expectation maximization on their agreements, over the counts of vote patterns
(at most 3 to the number of functions, pre-aggregated before they reach the driver),
and every pattern gets its posterior over prose, list, table and junk.

The body of a text is what follows its heading or opening sentence; where nothing
follows, it is the whole text.

Defined results: null, empty and blank texts have figures of 0 and the type
'blank', whose posterior is not estimated; repeated rows are counted each; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.session import materialize

TYPES = ("prose", "list", "table", "junk")
#: Characters of text that are split into words at once.
SLICE_CHARS = 4_000_000
ABBREVIATION = r"(?:(?i:figs?|abb|nos?|art|ex|temp|etc|z\.B|bzw|vgl)\.\s)"
OPENING = rf"^(?P<o>(?:{ABBREVIATION}|[^.!?\r\n]|[.!?][^\s])*(?:[.!?](?:\s+|$)|[\r\n]+))"
LINE_END = r"[.!?:;]['\"”»)\]]*\s*$"
DELIMITED = r"\||\t|\S {2,}\S"
LABELLED = r"^\s*(?:\(?[0-9]{1,4}[.):]?\s|\(?[a-zA-Z][.)]\s|[-•*–·]\s|(?i:fig|no|nr|abb)\.?\s*[0-9]|[^:.!?]{2,60}:\s+\S)"
GARBLED = re.compile(r"[^\W\d_][^\w\s'’‐‑–.,/·+<>&;{}=^()\[\]-]|[^\w\s(\[\"'“«¿¡<&{·+*±~≥≤-][^\W\d_]")
MARKUP = re.compile(r"^(?:<[^>]*|[^<]*>|&\w+;|##\S+|\{\}|%\w+|null|\[image\]|[\w-]+:[\w#]+;|\w+=\"[^\"]*\"?/?>?)$", re.I)
STRIPPED = ".,;:()[]\"'!?"

SCHEMA = (
    "doc long, chars long, words long, mean_word double, symbol_share double, letter_share double, lines long, ended_lines double, "
    "common_share double, distinct_share double, body_words long, body_common double, body_common_kinds long, "
    "garbled_share double, markup_share double, longest_share double, delimited_lines double, labelled_lines double, "
    "words_a_line double, words_a_sentence double, separator_share double, distinct_lines double, variety double"
)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a), np.float64), where=b > 0)


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)


def _measure(docs: pa.Array, texts: pa.Array, common: frozenset[str]) -> pa.RecordBatch:
    texts = pc.utf8_trim_whitespace(pc.fill_null(texts, ""))
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(texts)
    opening = pc.struct_field(pc.extract_regex(texts, OPENING), "o")
    opened = pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(opening, ""))))
    lists = pc.utf8_split_whitespace(texts)
    at = _offsets(lists)
    raw = lists.flatten()
    # splitting an empty text gives one empty word
    coded = pc.utf8_lower(pc.utf8_trim(raw, characters=STRIPPED)).dictionary_encode()
    kinds, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    flag = lambda f: np.fromiter((f(w) for w in kinds), np.float64, len(kinds))
    real = flag(lambda w: w != "")[index] if len(index) else np.zeros(0)
    words = _sums(real, at)
    start = at[:-1] + np.where(chars > 0, np.minimum(opened.to_numpy(zero_copy_only=False), np.diff(at)), 0)
    start = np.where(start >= at[1:], at[:-1], start)
    body = np.stack([start, at[1:]], axis=1)

    def within(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
        return total[body[:, 1]] - total[body[:, 0]]

    is_common = flag(lambda w: w in common)
    doc_of = np.repeat(np.arange(n), np.diff(at))
    body_words = within(real)
    in_body = np.arange(len(index)) >= np.repeat(start, np.diff(at))
    picked = (is_common[index] > 0) & in_body if len(index) else np.zeros(0, bool)
    pairs = np.unique(doc_of[picked] * np.int64(len(kinds) + 1) + index[picked])
    common_kinds = np.bincount((pairs // (len(kinds) + 1)).astype(np.int64), minlength=n)
    every = pc.unique(pa.array(doc_of * np.int64(len(kinds) + 1) + index)).to_numpy(zero_copy_only=False)
    distinct = np.bincount((every // (len(kinds) + 1)).astype(np.int64), minlength=n)
    length = flag(len)
    of = lambda f: f[index] if len(index) else np.zeros(0)
    ends = pc.match_substring_regex(raw, r"[.!?]['\"”»)]*$").to_numpy(zero_copy_only=False).astype(np.float64)
    letters = _sums(of(flag(lambda w: sum(map(str.isalpha, w)))), at)
    solid = _sums(pc.utf8_length(raw).to_numpy(zero_copy_only=False), at)
    digits = _sums(of(flag(lambda w: sum(map(str.isdigit, w)))), at)
    line_lists = pc.split_pattern_regex(texts, r"[\r\n]+")
    line_at, line = _offsets(line_lists), line_lists.flatten()
    filled = pc.match_substring_regex(line, r"\S").to_numpy(zero_copy_only=False).astype(np.float64)
    line_share = lambda p: _share(_sums(pc.match_substring_regex(line, p).to_numpy(zero_copy_only=False) * filled, line_at), lines)
    lines = _sums(filled, line_at)
    separators = pc.match_substring_regex(raw, r"^[|/>•·;–-]$|[;|>]$").to_numpy(zero_copy_only=False).astype(np.float64)
    gaps = pc.count_substring_regex(texts, r"\S(?:\t| {2,})").to_numpy(zero_copy_only=False).astype(np.float64)
    line_of = np.repeat(np.arange(n), np.diff(line_at))
    line_code = line.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seen = pc.unique(pa.array((line_of << 32 | line_code)[filled > 0])).to_numpy(zero_copy_only=False)
    line_kinds = _share(np.bincount(seen >> 32, minlength=n).astype(np.float64), lines)
    columns = [
        docs, chars.astype(np.int64), words.astype(np.int64), _share(_sums(of(length), at), words),
        _share(solid - letters - digits, solid), _share(letters, solid), lines.astype(np.int64), line_share(LINE_END),
        _share(_sums(of(is_common), at), words), _share(distinct.astype(np.float64), words), body_words.astype(np.int64),
        _share(within(of(is_common)), body_words), common_kinds.astype(np.int64),
        _share(within(of(flag(lambda w: GARBLED.search(w) is not None))), body_words),
        _share(within(of(flag(lambda w: MARKUP.match(w) is not None))), body_words),
        _share(within(of(flag(lambda w: len(w) > 40))), body_words),
        line_share(DELIMITED), line_share(LABELLED), _share(words, lines), _share(body_words, within(ends)),
        _share(_sums(separators, at) + gaps, words), line_kinds, _share(distinct.astype(np.float64), np.sqrt(words)),
    ]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def text_statistics(docs: DataFrame, common_words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of SCHEMA for every row; ``doc`` is the id."""
    common = frozenset(w.lower() for w in common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
                part = b.slice(at, stop - at)
                yield _measure(part.column(0), part.column(1), common)
                at = stop

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Labeller:
    """Votes for ``types`` where ``yes`` holds, against them where ``no`` holds, else abstains."""

    name: str
    types: frozenset[str]
    yes: Column
    no: Column = field(default_factory=lambda: F.lit(False))


#: Figures of which the median over all texts is the measure, and shares that are split in two classes.
TYPICAL = ("body_common", "richness", "words_a_sentence", "words_a_line", "variety")
SPLIT = ("garbled_share", "delimited_lines", "labelled_lines", "separator_share", "distinct_lines", "longest_share", "symbol_share")
BINS = 100


def richness(usual: float) -> Column:
    """Kinds of common words in the body for its length; beyond the ``usual`` length few new ones come."""
    return F.col("body_common_kinds") / F.sqrt(F.greatest(F.least(F.col("body_words"), F.lit(max(usual, 1.0))), F.lit(1.0)))


def split_point(counts: np.ndarray) -> float:
    """Where a histogram over 0 to 1 falls into two classes of the least variance within; 0.5 where it has one value only."""
    centre = (np.arange(len(counts)) + 0.5) / len(counts)
    below, mass = np.cumsum(counts, dtype=np.float64), np.cumsum(counts * centre)
    total = below[-1] if len(below) else 0.0
    within = (below > 0) & (below < total)
    if not within.any():
        return 0.5
    between = np.zeros(len(counts))
    between[within] = (mass[-1] * below[within] / total - mass[within]) ** 2 / (below[within] * (total - below[within]))
    return (int(np.argmax(between)) + 1) / len(counts)


def learn_thresholds(statistics: DataFrame) -> dict[str, float]:
    """The medians of TYPICAL and the split points of SPLIT over all texts with words.

    Histograms of a fixed number of bins are what reaches the driver.
    """
    real = statistics.filter("words > 0")
    usual = float(real.agg(F.percentile_approx("body_words", 0.5, 1000)).first()[0] or 0)
    real = real.withColumn("richness", richness(usual))
    medians = real.agg(*[F.percentile_approx(c, 0.5, 1000).alias(c) for c in TYPICAL]).first()
    bins = [F.struct(F.lit(c).alias("c"), F.least((F.col(c) * BINS).cast("int"), F.lit(BINS - 1)).alias("bin")) for c in SPLIT]
    counted = real.select(F.inline(F.array(*bins))).groupBy("c", "bin").count().collect()
    counts = {c: np.zeros(BINS) for c in SPLIT}
    for r in counted:
        counts[r["c"]][r["bin"]] += r["count"]
    return {"usual": usual} | {c: float(medians[c] or 0.0) for c in TYPICAL} | {c: split_point(h) for c, h in counts.items()}


def labellers(at: dict[str, float]) -> list[Labeller]:
    """The labelling functions, their thresholds taken from ``learn_thresholds``: shares of what is typical, and split points."""
    c = F.col
    prose, table, lists, junk = (frozenset([t]) for t in TYPES[:1] + ("table", "list", "junk"))
    typical = lambda name, share: c(name) >= share * at[name]
    enough = c("body_words") >= 12
    rich = richness(at["usual"])
    repeated = ~typical("variety", 0.4) & (c("words") > 12) | (c("distinct_lines") < at["distinct_lines"]) & (c("lines") > 5)
    garbled = c("garbled_share") >= at["garbled_share"]
    clean = ~garbled & ~repeated & typical("words_a_line", 0.15)
    few_lines = clean & (c("labelled_lines") < at["labelled_lines"]) & (c("delimited_lines") < at["delimited_lines"])
    odd = (c("words") == 0) | garbled | repeated | (c("markup_share") >= 0.3) | (c("longest_share") >= at["longest_share"]) | (c("symbol_share") >= at["symbol_share"]) & (c("body_common_kinds") < 3)
    return [
        Labeller("common words", prose, few_lines & typical("body_common", 0.6) & (c("body_common_kinds") >= 3), ~typical("body_common", 0.15)),
        Labeller("kinds of common words", prose, clean & (rich >= 0.6 * at["richness"]), enough & (rich < 0.4 * at["richness"])),
        Labeller("sentences", prose, typical("words_a_sentence", 0.5) & ~typical("words_a_sentence", 4.0) & few_lines & (c("body_common_kinds") >= 3), ~typical("words_a_sentence", 0.4) | typical("words_a_sentence", 8.0)),
        Labeller("lines", prose, few_lines & typical("words_a_line", 0.4) & (c("ended_lines") > 0.2), ~typical("words_a_line", 0.22) & (c("lines") > 3)),
        Labeller("delimiters", table, (c("delimited_lines") >= at["delimited_lines"]) & (c("lines") > 2), (c("delimited_lines") < at["delimited_lines"] / 4) & (c("lines") > 2)),
        Labeller("labels", lists, (c("labelled_lines") >= 2 * at["labelled_lines"]) & (c("lines") > 2) & (c("delimited_lines") < at["delimited_lines"])),
        Labeller("separators", lists | table, c("separator_share") >= at["separator_share"] / 3),
        Labeller("junk", junk, odd, (c("letter_share") > 0.7) & typical("variety", 0.4) & (c("distinct_lines") > at["distinct_lines"]) & (c("garbled_share") < at["garbled_share"] / 3)),
    ]


@dataclass
class Model:
    """Class shares and accuracies learnt from vote patterns."""

    prior: np.ndarray
    accuracy: np.ndarray
    targets: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """votes: patterns x functions of +1 (in the set), -1 (outside), 0. -> patterns x types."""
        log = np.tile(np.log(self.prior), (len(votes), 1))
        for j, (a, target) in enumerate(zip(self.accuracy, self.targets, strict=True)):
            agree = np.where(votes[:, j, None] > 0, target[None, :], ~target[None, :])
            log += np.where(votes[:, j, None] == 0, 0.0, np.where(agree, np.log(a), np.log1p(-a)))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(axis=1, keepdims=True)


def learn(votes: np.ndarray, counts: np.ndarray, targets: np.ndarray, rounds: int = 50, start: float = 0.85) -> Model:
    """Expectation maximization from equal accuracies; they stay within 0.55 and 0.999."""
    model = Model(np.full(targets.shape[1], 1 / targets.shape[1]), np.full(votes.shape[1], start), targets)
    for _ in range(rounds):
        p = model.posterior(votes) * counts[:, None]
        prior = (p.sum(axis=0) + 1) / (p.sum() + p.shape[1])
        accuracy = []
        for j, target in enumerate(targets):
            voted = votes[:, j] != 0
            agree = np.where(votes[:, j, None] > 0, target[None, :], ~target[None, :])
            hit, seen = (p * agree)[voted].sum(), p[voted].sum()
            accuracy.append((hit + 8.5) / (seen + 10))
        model = Model(prior, np.clip(accuracy, 0.55, 0.999), targets)
    return model


def text_types(statistics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Statistics with ``text_type`` and the posteriors ``p_prose`` ... ``p_junk``; thresholds are learnt from all texts, or given."""
    rules = labellers(thresholds or learn_thresholds(statistics))
    vote = lambda r: F.when(r.yes, "+").when(r.no, "-").otherwise("0")
    voted = statistics.withColumn("votes", F.when(F.col("chars") > 0, F.concat(*map(vote, rules))))
    patterns = voted.filter("votes IS NOT NULL").groupBy("votes").count().collect()  # at most 3 ** len(rules)
    targets = np.array([[t in r.types for t in TYPES] for r in rules])
    codes = {"+": 1, "-": -1, "0": 0}
    votes = np.array([[codes[x] for x in r["votes"]] for r in patterns], np.int8).reshape(len(patterns), len(rules))
    model = learn(votes, np.array([r["count"] for r in patterns], np.float64), targets)
    posterior = model.posterior(votes)
    rows = [(r["votes"], TYPES[int(np.argmax(p))], *map(float, p)) for r, p in zip(patterns, posterior, strict=True)]
    table = statistics.sparkSession.createDataFrame(rows, "votes string, type string, " + ", ".join(f"p_{t} double" for t in TYPES))
    out = voted.join(F.broadcast(table), "votes", "left").withColumn("text_type", F.coalesce("type", F.lit("blank")))
    return out.drop("type")


def documents_by_type(docs: DataFrame, common_words: list[str], id_col: str = "doc_id", text_col: str = "text", thresholds: dict[str, float] | None = None) -> DataFrame:
    """``text_types`` of the documents' statistics, measured once and written."""
    return text_types(materialize(text_statistics(docs, common_words, id_col, text_col), "statistics"), thresholds)
