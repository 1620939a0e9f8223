"""Queries and SQL of this package, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm.addresses import place_of_records, same_places
from kinspark.llm.consolidate import tied_groups
from kinspark.llm.lookalike import consistent_forms
from kinspark.llm.match import match_sources, source_members
from kinspark.llm.packing import fill_containers
from kinspark.llm.quality import documents_by_type
from kinspark.llm.survivor import company_survivors
from kinspark.llm.tokens import count_tokens, decode_corpus, encode_corpus
from kinspark.llm.variants import variant_members, variant_pairs
from kinspark.session import materialize, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, field, rec_id: the record that supplies each field of each tied group."""
    companies = read_table(spark, sf_dir, "companies_filtered")
    groups = materialize(tied_groups(companies), "groups")
    return company_survivors(companies, groups).select("group_id", "field", "rec_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, group_id of every record tied to another by a usable LEI or QID."""
    return tied_groups(read_table(spark, sf_dir, "companies_filtered"))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, field, rec_id, layer: the same filled from the lowest dominance layer that has a value."""
    companies = read_table(spark, sf_dir, "companies_filtered")
    return company_survivors(companies, materialize(tied_groups(companies), "groups"), "layers")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_survivors": p1_survivors,
    "p2_found": p2_found,
}


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document."""
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, restored: whether decoding its ids gives the document's text again."""
    docs = read_table(spark, sf_dir, "documents")
    decoded = decode_corpus(encode_corpus(docs)).withColumnRenamed("text", "decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text").join(decoded, "doc_id").select("doc_id", same.alias("restored"))


QUERIES |= {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_name, doc_id, piece, tokens, container of every document under every pack."""
    limits = read_table(spark, sf_dir, "pack_limits").select("pack_name", "capacity").orderBy("pack_name")
    packs = [(r["pack_name"], r["capacity"]) for r in limits.collect()]  # one row a pack
    counted = count_tokens(read_table(spark, sf_dir, "documents"))
    return fill_containers(counted, packs, "doc_id", "tokens").withColumnRenamed("size", "tokens")


QUERIES |= {"p8_containers": p8_containers}


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [r["word"] for r in read_table(spark, sf_dir, "common_words").select("word").collect()]  # a fixed list
    return documents_by_type(read_table(spark, sf_dir, "documents"), words)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of every document whose text is a list, a table or junk."""
    typed = _typed(spark, sf_dir).filter((F.col("chars") > 0) & (F.col("p_prose") < 0.5))
    return typed.select(F.col("doc").alias("doc_id"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of text quality and the text type of every document."""
    shown = ["words", "mean_word", "symbol_share", "ended_lines", "common_share", "distinct_share", "text_type"]
    return _typed(spark, sf_dir).select(F.col("doc").alias("doc_id"), *shown)


QUERIES |= {"p9_found": p9_found, "p9_statistics": p9_statistics}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, field of every name and address that its consistent form changes."""
    return consistent_forms(read_table(spark, sf_dir, "companies_filtered"), "rec_id", ["name", "address"]).select("rec_id", "field")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, field, value, form of every changed name and address."""
    return consistent_forms(read_table(spark, sf_dir, "companies_filtered"), "rec_id", ["name", "address"])


QUERIES |= {"p6_found": p6_found, "p6_forms": p6_forms}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id_a, rec_id_b: records of one company under different names."""
    return variant_pairs(read_table(spark, sf_dir, "companies_filtered"), read_table(spark, sf_dir, "country_aliases"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, company, links: every record under its company, with the number of its links."""
    return variant_members(read_table(spark, sf_dir, "companies_filtered"), read_table(spark, sf_dir, "country_aliases"))


QUERIES |= {"p5_found": p5_found, "p5_members": p5_members}


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id_a, rec_id_b, confidence: records of one company in two sources."""
    return match_sources(read_table(spark, sf_dir, "companies_filtered"), read_table(spark, sf_dir, "country_aliases"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id_a, rec_id_b: records of one company in two sources without a common identifier."""
    return p3_matches(spark, sf_dir).select("rec_id_a", "rec_id_b")


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, company, confidence, sources: every record under its company, with the number of sources that have it."""
    return source_members(read_table(spark, sf_dir, "companies_filtered"), read_table(spark, sf_dir, "country_aliases"))


QUERIES |= {"p3_found": p3_found, "p3_matches": p3_matches, "p3_members": p3_members}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id_a, rec_id_b: records at one street and house number, written differently."""
    return same_places(read_table(spark, sf_dir, "companies_filtered"))


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, street, number, postal: the place of every record; grows with the records, not with their pairs."""
    return place_of_records(read_table(spark, sf_dir, "companies_filtered"))


QUERIES |= {"p4_found": p4_found, "p4_places": p4_places}
