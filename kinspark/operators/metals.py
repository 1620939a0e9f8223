"""Metals: building the catalogue, resolving names and symbols, listing."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.functions.normalize import form_hint, metal_id, metal_part, normalize_metal_name, slugify_metal_name
from kinspark.functions.similarity import weighted_ratio_udf

N_ALIASES = 10
#: Letters of the hard block and of symbols, and the score a match needs.
PREFIX, SYMBOL, THRESHOLD = 3, 3, 90.0
OPTIONAL = ("symbol", "formula", "code", "group_name", "hs6", "pra_hint", "notes", "source_priority")


def load_yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def metals_of_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Metals of a YAML file with a list ``metals`` of mappings; sources become the source priority."""
    columns = ["name", "metal_key", "category_bucket", "cluster_id", "default_unit", "default_basis", *OPTIONAL]
    rows = []
    for m in load_yaml(path)["metals"]:
        m = m | {"source_priority": "|".join(m.get("sources") or [])}
        rows.append((*[None if m.get(c) is None else str(m[c]) for c in columns], [str(a) for a in m.get("aliases") or []]))
    return spark.createDataFrame(rows, ", ".join([*[f"{c} string" for c in columns], "aliases array<string>"]))


def clusters_of_yaml(spark: SparkSession, path: str) -> DataFrame:
    clusters = load_yaml(path)["clusters"]
    rows = [(k, v.get("name"), v.get("description"), v.get("notes"), list(v.get("sources") or [])) for k, v in clusters.items()]
    return spark.createDataFrame(rows, "cluster_id string, name string, description string, notes string, sources array<string>")


def build_metals(raw: DataFrame) -> DataFrame:
    """The catalogue: id, key, normal name and alias1 .. alias10 for each metal, '' for what is missing, by name."""
    df = raw.withColumns({c: F.lit(None).cast("string") for c in ("metal_key", *OPTIONAL) if c not in raw.columns})
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c not in ("aliases", "metal_key")}
    key = F.coalesce(F.nullif(F.col("metal_key"), F.lit("")), slugify_metal_name(F.col("name")))
    aliases = {f"alias{i + 1}": F.coalesce(F.get("aliases", F.lit(i)), F.lit("")) for i in range(N_ALIASES)}
    named = {"metal_key": key, "metal_id": metal_id(F.col("name")), "name_norm": normalize_metal_name(F.col("name"))}
    return df.withColumns(named | aliases).withColumns(filled).drop("aliases").orderBy("name")


def alias_keys() -> Column:
    keys = F.transform(F.array(*[F.col(f"alias{i + 1}") for i in range(N_ALIASES)]), normalize_metal_name)
    return F.filter(keys, lambda k: k != "")


def _scored(pairs: DataFrame) -> DataFrame:
    """The best score over the name and all aliases; every pair of texts is scored once."""
    texts = pairs.select("query_id", "metal_id", "q_norm", F.explode(F.concat(F.array("name_norm"), alias_keys())).alias("text"))
    best = texts.withColumn("s", weighted_ratio_udf("q_norm", "text")).groupBy("query_id", "metal_id").agg(F.max("s").alias("score"))
    return pairs.join(best, ["query_id", "metal_id"])


def _asked(queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.col("name").alias("asked"), *[c for c in ("category", "cluster") if c in queries.columns])
    for c in ("category", "cluster"):
        if c not in q.columns:
            q = q.withColumn(c, F.lit(None).cast("string"))
    q = q.withColumn("q_norm", normalize_metal_name(metal_part(F.col("asked")))).withColumn("hint", normalize_metal_name(form_hint(F.col("asked"))))
    return q.filter("q_norm <> ''").withColumn("hint", F.nullif("hint", F.lit("")))


def _prefix_pairs(q: DataFrame, metals: DataFrame, block_on_aliases: bool) -> DataFrame:
    keys = F.concat(F.array("name_norm"), alias_keys()) if block_on_aliases else F.array("name_norm")
    starts = metals.select("*", F.explode(F.array_distinct(F.transform(keys, lambda k: F.substring(k, 1, PREFIX)))).alias("prefix"))
    long = q.filter(F.length("q_norm") >= PREFIX).withColumn("prefix", F.substring("q_norm", 1, PREFIX)).join(starts, "prefix").drop("prefix")
    short = q.filter(F.length("q_norm") < PREFIX).join(metals, F.lit(True))  # one or two letters tell nothing: all metals
    pairs = long.unionByName(short)
    return pairs.filter(F.col("hint").isNull() | F.contains("name_norm", "hint"))


def resolve_metals(queries: DataFrame, metals: DataFrame, threshold: float = THRESHOLD, block_on_aliases: bool = False) -> DataFrame:
    """The metal of each query (query_id, name, optional category and cluster) that has one, with its score.

    A text of up to three letters that is a symbol decides at once, whatever the
    category; else the best of the metals with the same first three letters (and
    category, cluster and form) from ``threshold`` on, the first by name among equals.
    ``block_on_aliases`` lets the first letters of an alias count too.
    """
    q = _asked(queries)
    symbols = metals.filter("symbol <> ''").withColumn("_symbol", F.lower("symbol"))
    hit = q.filter(F.length("q_norm") <= SYMBOL).join(symbols, F.col("q_norm") == F.col("_symbol")).drop("_symbol").withColumn("score", F.lit(100.0))
    rest = q.join(hit.select("query_id"), "query_id", "left_anti")
    pairs = _prefix_pairs(rest, metals, block_on_aliases)
    pairs = pairs.filter((F.col("category").isNull() | (F.col("category") == F.col("category_bucket"))) & (F.col("cluster").isNull() | (F.col("cluster") == F.col("cluster_id"))))
    scored = _scored(pairs).filter(F.col("score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "metal_id")
    return hit.unionByName(scored).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def top_metals(queries: DataFrame, metals: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best metals of each query with score and rank, without a threshold."""
    scored = _scored(_prefix_pairs(_asked(queries), metals, False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "metal_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.lit(k))


def list_metals(metals: DataFrame, cluster: str | None = None, category: str | None = None) -> DataFrame:
    if cluster is not None:
        metals = metals.filter(F.col("cluster_id") == cluster)
    return metals.filter(F.col("category_bucket") == category) if category is not None else metals
