"""Scalar conveniences over the DataFrame operators: one text in, one answer out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions import normalize
from kinspark.operators import countries, extract_companies, extract_metals, metals, resolve


def _one(spark: SparkSession, text: str | None, f) -> object:
    return spark.createDataFrame([(text,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


def normalize_name(spark: SparkSession, name: str) -> str:
    return _one(spark, name, normalize.normalize_company_name)


def get_company_id(company: dict, safe: bool = False) -> str:
    """``name:country`` of a record."""
    import re

    name, country = company.get("name", "Unknown"), company.get("country", "XX")
    return f"{re.sub('[^A-Za-z0-9]+', '_', name).strip('_')}_{country}" if safe else f"{name}:{country}"


def _asked(spark: SparkSession, names: list[str], country: str | None) -> DataFrame:
    return spark.createDataFrame([(i, n, country) for i, n in enumerate(names)], "query_id long, name string, country string")


def resolve_company(spark: SparkSession, catalogue: DataFrame, name: str, country: str | None = None, **options) -> dict:
    return resolve.resolve(_asked(spark, [name], country), catalogue, **options).first().asDict(recursive=True)


def match_company(spark: SparkSession, catalogue: DataFrame, name: str, country: str | None = None) -> dict | None:
    return resolve_company(spark, catalogue, name, country)["final"]


def company_identifier(spark: SparkSession, catalogue: DataFrame, name: str, country: str | None = None) -> str | None:
    return resolve.identifiers(_asked(spark, [name], country), catalogue).first()["identifier"]


get_identifier = company_identifier


def list_companies(catalogue: DataFrame, **options) -> DataFrame:
    return resolve.list_companies(catalogue, **options)


def extract_companies_from_text(spark: SparkSession, catalogue: DataFrame, text: str, **options) -> list[dict]:
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return [r.asDict() for r in extract_companies.document_companies(docs, catalogue, "doc_id", "text", **options).orderBy("start").collect()]


def country_identifiers(spark: SparkSession, names: list[str], to: str = "ISO2", **options) -> list[str | None]:
    """Codes of names, in their order."""
    if not names:
        return []
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    found = countries.resolve_countries(df, "name", countries.country_dimension(spark), to, **options)
    return [r["code"] for r in found.orderBy("i").collect()]


def country_identifier(spark: SparkSession, name: str, to: str = "ISO2", **options) -> str | None:
    return country_identifiers(spark, [name], to, **options)[0]


def metal_identifier(spark: SparkSession, catalogue: DataFrame, name: str, cluster: str | None = None, category: str | None = None, threshold: float = metals.THRESHOLD) -> dict | None:
    asked = spark.createDataFrame([(0, name, category, cluster)], "query_id long, name string, category string, cluster string")
    row = metals.resolve_metals(asked, catalogue, threshold).select(*catalogue.columns).first()
    return row.asDict() if row else None


def match_metal(spark: SparkSession, catalogue: DataFrame, name: str, k: int = 5) -> list[dict]:
    asked = spark.createDataFrame([(0, name)], "query_id long, name string")
    return [r.asDict() for r in metals.top_metals(asked, catalogue, k).orderBy("rank").select(*catalogue.columns, "score").collect()]


def extract_metals_from_text(spark: SparkSession, text: str, cluster_hint: str | None = None) -> list[dict]:
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return [r.asDict() for r in extract_metals.document_metals(docs, "doc_id", "text", cluster_hint).orderBy("start").collect()]


def extract_metal_pairs(spark: SparkSession, text: str) -> list[tuple[str, str]]:
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return [(r["first"], r["second"]) for r in extract_metals.metal_pairs(docs, "doc_id", "text").orderBy("position").collect()]
