"""Knowledge-base results: SPARQL bindings, the query text, and the same query over a local dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions.normalize import qid_of_url

BINDINGS_SCHEMA = "results struct<bindings array<map<string, struct<value string>>>>"


def parse_bindings(pages: DataFrame) -> DataFrame:
    """One row a binding: missing values are '', aliases a list split at the bars, country always ''."""
    b = pages.select(F.explode("results.bindings").alias("b"))
    value = lambda k: F.coalesce(F.try_element_at("b", F.lit(k))["value"], F.lit(""))
    return b.select(
        qid_of_url(value("company")).alias("wikidata_qid"),
        value("companyLabel").alias("name"),
        value("lei").alias("lei"),
        F.lit("").alias("country"),
        *[value(k).alias(k) for k in ("official_website", "stock_ticker", "inception")],
        F.when(value("aliases") == "", F.array().cast("array<string>")).otherwise(F.split(value("aliases"), r"\|")).alias("aliases"),
    )


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    return parse_bindings(spark.read.schema(BINDINGS_SCHEMA).option("multiLine", True).json(path))


def companies_of_dump(
    entities: DataFrame, facts: DataFrame, labels: DataFrame, limit: int = 10000, countries: list[str] | None = None, include_dissolved: bool = False
) -> DataFrame:
    """The remote query over a local dump.

    entities(qid, name); facts(qid, property, value) with the properties lei, country,
    website, ticker, inception, dissolved; labels(qid, alias). Optional patterns are
    left joins, dissolved entities are left out by an anti join, aliases are
    concatenated, single values are the smallest.
    """
    one = facts.groupBy("qid").pivot("property", ["lei", "country", "website", "ticker", "inception"]).agg(F.min("value"))
    live = entities if include_dissolved else entities.join(facts.filter("property = 'dissolved'"), "qid", "left_anti")
    names = labels.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))
    out = live.join(one, "qid", "left").join(names, "qid", "left")
    if countries:
        out = out.filter(F.col("country").isin(countries))
    return out.withColumn("inception", F.year(F.to_date("inception"))).orderBy("qid").limit(limit)
