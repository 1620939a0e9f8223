"""Counts, coverage, match quality and validation of catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.functions.normalize import unit_fits_basis


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, count): non-null values by falling count, then by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def top_shares(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their percentage of all rows, one decimal."""
    total = df.agg(F.count("*").alias("total"))  # one row
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    shared = counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col("count") / F.col("total"), 1))
    return shared.drop("total").orderBy(F.desc("count"), column).limit(n)


def coverage(df: DataFrame, columns: list[str], empty_is_missing: bool = False) -> DataFrame:
    """(field, filled, percent) of columns, one scan."""
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False)) if empty_is_missing else F.col(c).isNotNull()
    one = df.agg(F.count("*").alias("_all"), *[F.count_if(there(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.round(100.0 * F.col(c) / F.nullif(F.col("_all"), F.lit(0)), 1).alias("percent")) for c in columns])
    return one.select(F.inline(rows))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(field, distinct) of non-null values."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(*[f(F.col(c)).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("distinct")) for c in columns])))


def link_quality(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """exact, fuzzy, mean and least score, and distinct matches as a share of the queries."""
    total = queries.agg(F.count("*").alias("queries"))  # one row
    figures = matches.agg(
        F.count_if(F.col("match_type") == "exact").alias("exact"),
        F.count_if(F.col("match_type") == "fuzzy").alias("fuzzy"),
        F.avg("score").alias("mean_score"),
        F.min("score").alias("least_score"),
        F.count_distinct("match_key").alias("matched"),
    )
    return figures.crossJoin(F.broadcast(total)).withColumn("rate", F.round(F.col("matched") / F.nullif(F.col("queries"), F.lit(0)), 4))


def validate_metals(metals: DataFrame, clusters: DataFrame, required: list[str]) -> DataFrame:
    """(check, key, detail): duplicate ids and keys, unknown clusters, units outside their basis, missing fields."""
    key = F.col("metal_key")

    def finding(df: DataFrame, check: str, detail: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), key.alias("key"), detail.cast("string").alias("detail"))

    def repeated(c: str) -> DataFrame:
        return metals.join(metals.dropna(subset=[c]).groupBy(c).count().filter("count > 1").select(c), c, "left_semi")

    unknown = metals.filter("cluster_id IS NOT NULL").join(clusters.select("cluster_id"), "cluster_id", "left_anti")
    parts = [
        finding(repeated("metal_id"), "duplicate metal_id", F.col("metal_id")),
        finding(repeated("metal_key"), "duplicate metal_key", key),
        finding(unknown, "unknown cluster", F.col("cluster_id")),
        finding(metals.filter(~unit_fits_basis(F.col("default_unit"), F.col("default_basis"))), "unit outside basis", F.concat_ws(" / ", "default_unit", "default_basis")),
        *[finding(metals.filter(F.coalesce(F.col(c), F.lit("")) == ""), "missing field", F.lit(c)) for c in required],
    ]
    return reduce(DataFrame.unionByName, parts)


def render(profile: DataFrame, title: str) -> str:
    """A small profile as text; for reports of a bounded number of rows."""
    rows = profile.collect()
    return "\n".join([title, *["  " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in rows]])
