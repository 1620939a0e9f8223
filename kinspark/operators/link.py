"""Linking listings to a registry: exact names first, then the best similar name in the country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.functions.normalize import canonicalize_company_name
from kinspark.functions.similarity import weighted_ratio_udf
from kinspark.operators.dedupe import keep_first


def _keyed(df: DataFrame) -> DataFrame:
    return df.filter("name IS NOT NULL AND country IS NOT NULL").withColumn("canon", F.lower(canonicalize_company_name(F.col("name"))))


def link_exact(listings: DataFrame, registry: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(matches, rest): listings whose display name is in the registry of their country, and those left.

    Of registry rows with one name the last by ``order`` counts.
    """
    index = keep_first(_keyed(registry), ["country", "canon"], [F.desc(order), F.col("name")]).select("country", "canon", F.col(order).alias("match_key"), F.col("name").alias("match_name"))
    asked = _keyed(listings)
    matches = asked.join(index, ["country", "canon"]).withColumn("score", F.lit(100.0)).withColumn("match_type", F.lit("exact"))
    return matches, asked.join(index.select("country", "canon"), ["country", "canon"], "left_anti")


def link_fuzzy(rest: DataFrame, registry: DataFrame, order: str, threshold: float = 85.0, block_on_word: bool = False) -> DataFrame:
    """The best registry name of the country for each listing, from ``threshold`` on; ties go to the first by ``order``.

    Names are compared once per distinct (country, name) of both sides. ``block_on_word``
    only compares names with a common word, for registries too large for a country scan.
    """
    index = keep_first(_keyed(registry), ["country", "canon"], [F.desc(order), F.col("name")]).select("country", F.col("canon").alias("other"), F.col(order).alias("match_key"), F.col("name").alias("match_name"))
    names = rest.select("country", "canon").distinct()
    if block_on_word:
        words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2)))
        pairs = names.withColumn("word", words("canon")).join(index.withColumn("word", words("other")), ["country", "word"]).drop("word").distinct()
    else:
        pairs = names.join(index, "country")
    scored = pairs.withColumn("score", weighted_ratio_udf("canon", "other")).filter(F.col("score") >= threshold)
    best = Window.partitionBy("country", "canon").orderBy(F.desc("score"), "match_key")
    top = scored.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "other")
    return rest.join(top, ["country", "canon"]).withColumn("match_type", F.lit("fuzzy"))


def link(listings: DataFrame, registry: DataFrame, order: str, threshold: float = 85.0, block_on_word: bool = False) -> DataFrame:
    """Exact matches and, for the listings without one, fuzzy matches."""
    exact, rest = link_exact(listings, registry, order)
    return exact.unionByName(link_fuzzy(rest, registry, order, threshold, block_on_word))


def matched_rows(registry: DataFrame, matches: DataFrame, order: str) -> DataFrame:
    """Registry rows that some listing matched."""
    return registry.join(matches.select(F.col("match_key").alias(order)), order, "left_semi")
