"""Classification of entities by words and codes, or by a pluggable classifier behind a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.functions.normalize import cache_key
from kinspark.operators.dedupe import has_text, keep_first
from kinspark.session import materialize

RESULT = "key string, is_relevant boolean, category string, reasoning string, confidence double, metal_intensity string, key_activities array<string>"


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether a text contains one of the words, in any case; false for null."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(c), F.lit(w.lower()))
    return F.coalesce(hit, F.lit(False))


def matches_sector(df: DataFrame, names: list[str], words: list[str], codes: dict[str, list[str]]) -> Column:
    """Whether a known name or a word occurs in the name, a word in industry, sector or an alias, or a code starts with one given.

    Only columns that ``df`` has are looked at; aliases may be a list.
    """
    hit = contains_any(F.col("name"), names + words)
    if "name_norm" in df.columns:
        hit = hit | contains_any(F.col("name_norm"), names)
    for c in ("industry", "sector"):
        if c in df.columns:
            hit = hit | contains_any(F.col(c), words)
    for column, prefixes in codes.items():
        if column in df.columns:
            for p in prefixes:
                hit = hit | F.coalesce(F.startswith(F.upper(F.col(column).cast("string")), F.lit(p)), F.lit(False))
    if dict(df.dtypes).get("aliases", "").startswith("array"):
        hit = hit | F.coalesce(F.exists("aliases", lambda a: contains_any(a, words)), F.lit(False))
    return hit


def prompts(df: DataFrame, template: str, n_aliases: int = 3) -> Column:
    """``template`` with {name}, {country}, {aliases} and {industry} filled in; missing ones are empty."""
    out = F.lit(template)
    aliases = F.array_join(F.slice("aliases", 1, n_aliases), ", ") if "aliases" in df.columns else F.lit("")
    values = {"name": F.col("name"), "country": F.col("country"), "aliases": aliases, "industry": F.col("industry") if "industry" in df.columns else F.lit("")}
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return out


def classify_cached(df: DataFrame, cache: DataFrame, classify: Callable[[pd.DataFrame], pd.DataFrame], threshold: float = 0.7, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(relevant rows with their category, new cache rows).

    Rows without a name are dropped. Each distinct ``name|country`` that the cache lacks
    goes to ``classify`` once, in at most ``parallel`` tasks; it gets (key, name, country)
    and gives RESULT. Of a batch that fails every row is tried alone; rows that fail count
    as irrelevant and are not cached. The new rows are written once and read from there, so
    that nothing is classified twice. Relevant
    rows from ``threshold`` on stay, one a name and country.
    """
    named = df.filter(has_text(F.col("name"))).withColumn("key", cache_key(F.col("name"), F.col("country")))
    misses = named.select("key", "name", "country").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield classify(pdf)
                continue
            except Exception:  # noqa: BLE001
                rows = [pdf.iloc[[i]] for i in range(len(pdf))] if len(pdf) > 1 else []
            for row in rows:
                try:
                    yield classify(row)
                except Exception:  # noqa: BLE001
                    continue

    fresh = materialize(misses.repartition(parallel).mapInPandas(run, RESULT), "classified")
    known = cache.select(*[x.split()[0] for x in RESULT.split(", ")]).unionByName(fresh)
    joined = named.join(known.select("key", "is_relevant", "category", "confidence"), "key", "left")
    relevant = joined.filter(F.col("is_relevant") & (F.col("confidence") >= threshold)).withColumnRenamed("category", "value_chain_category")
    kept = keep_first(relevant, ["name", "country"], [F.desc("confidence"), F.col("key")])
    return kept.drop("key", "is_relevant", "confidence"), fresh


def read_cache(spark, path: str) -> DataFrame:
    """A cache kept as one JSON object of key -> result, as rows of RESULT."""
    kind = "map<string, struct<is_relevant boolean, category string, reasoning string, confidence double, metal_intensity string, key_activities array<string>>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("key", "v")).select("key", "v.*")


def write_cache(cache: DataFrame, path: str) -> None:
    """The cache as a Parquet table, which takes new rows without being rewritten."""
    cache.write.mode("append").parquet(path)
