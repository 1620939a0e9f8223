"""Best representative of each duplicate group by skyline selection.

Every record of a group is a point in the space of completeness (the number of fields
it has a value for), recency and trust. ``skyline_survivors`` computes the dominance
layers: layer 1 holds the records that no other record beats or equals on all three
axes, layer 2 those undominated once layer 1 is gone, and so on. The best record of layer
1 by the lexicographic policy leads; where it has no value for a field, that is filled:

* policy "layers": from the lowest layer that has a value, within it by the field's
  measure where it is graded, then trust, recency and the smaller id;
* policy "rank": from all layers by the field's measure, trust, recency and the smaller
  id. It is what the fixed ranking of p1_found asks for: a trusted record that is
  dominated may come before an undominated one of less trust. The leader is the same under
  both, as the first by rank is never dominated.

Scale: before a group is gathered, its records are reduced to candidates, the most
recent one of each cell of (trust, measures); partial aggregation does this ahead of the
shuffle. Layers are those of the candidates. What is gathered for a group is bounded by
the number of cells, not of its records.

Defined results: a null recency is the oldest; null measures count as 0 (no
value); ties end with the smaller id; a group in which no record has a value for
a field has no row for it; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.functions.aliases import count_different
from kinspark.functions.identifiers import source_key, usable_lei, usable_qid


def company_trust(source: Column) -> Column:
    """Trust tiers of company sources, 1 the most trusted."""
    key = source_key(source)
    return F.when(key == "gleif", 1).when(key == "wikidata", 2).when(key.isin("asx", "lse", "tsx"), 3).otherwise(4)


def company_measures() -> dict[str, Column]:
    """What each field of a company record is worth: 0 nothing, else the more the better."""
    return {
        "source": source_key(F.col("source")).isNotNull().cast("int"),
        "lei": usable_lei(F.col("lei")).isNotNull().cast("int"),
        "wikidata_qid": usable_qid(F.col("wikidata_qid")).isNotNull().cast("int"),
        "aliases": count_different(F.col("aliases")),
    }


def skyline_survivors(
    records: DataFrame, group: str, id_col: str, trust: Column, recency: Column, measures: dict[str, Column], policy: str = "layers"
) -> DataFrame:
    """(group, field, id, layer): the record that supplies each field of each group, and its dominance layer.

    trust: smaller is better. recency: a timestamp, later is better. measures: what a
    record's value of each field is worth, 0 for none. policy: "layers" or "rank".
    """
    if policy not in ("layers", "rank"):
        raise ValueError(f"no such policy: {policy}")
    names = list(measures)
    points = records.select(
        F.col(group).alias("g"),
        F.col(id_col).alias("id"),
        trust.alias("trust"),
        F.coalesce(-F.unix_micros(recency.cast("timestamp")), F.lit(2**62)).alias("age"),
        *[F.coalesce(m, F.lit(0)).alias(f"m{i}") for i, m in enumerate(measures.values())],
    )
    marks = [f"m{i}" for i in range(len(names))]
    cells = points.groupBy("g", "trust", *marks).agg(F.min(F.struct("age", "id")).alias("best"))
    # in this order (trust, age, id first) every record comes after all that dominate it
    cell = F.struct(
        "trust",
        F.col("best.age").alias("age"),
        F.col("best.id").alias("id"),
        *[(-F.col(m)).alias(m) for m in marks],
        sum((F.when(F.col(m) > 0, 1).otherwise(0) for m in marks), F.lit(0)).alias("filled"),
    )
    gathered = cells.groupBy("g").agg(F.sort_array(F.collect_list(cell)).alias("cells"))

    def beats(x: Column, y: Column) -> Column:
        # of equal age the smaller id is taken as the more recent, so that ties are ordered on all axes
        recent = (x["age"] < y["age"]) | ((x["age"] == y["age"]) & (x["id"] <= y["id"]))
        return (x["trust"] <= y["trust"]) & recent & (x["filled"] >= y["filled"])

    def add(acc: Column, y: Column) -> Column:
        above = F.array_max(F.transform(F.filter(acc, lambda x: beats(x["cell"], y)), lambda x: x["layer"]))
        return F.concat(acc, F.array(F.struct((F.coalesce(above, F.lit(0)) + 1).alias("layer"), y.alias("cell"))))

    kind = cells.select(cell.alias("c")).schema["c"].dataType.simpleString()
    layered = gathered.select("g", F.aggregate("cells", F.lit(None).cast(f"array<struct<layer:int,cell:{kind}>>"), lambda a, y: add(F.coalesce(a, F.array().cast(f"array<struct<layer:int,cell:{kind}>>")), y)).alias("points"))

    def pick(m: str) -> Column:
        having = F.filter("points", lambda p: p["cell"][m] < 0)
        ranked = F.transform(
            having,
            lambda p: F.struct((p["layer"] if policy == "layers" else F.lit(0)).alias("order"), p["cell"][m].alias("less"), p["cell"]["trust"].alias("trust"), p["cell"]["age"].alias("age"), p["cell"]["id"].alias("id"), p["layer"].alias("layer")),
        )
        return F.array_min(ranked)

    picks = F.array(*[F.struct(F.lit(n).alias("field"), pick(m).alias("p")) for n, m in zip(names, marks, strict=True)])
    flat = layered.select("g", F.explode(picks).alias("x")).filter("x.p IS NOT NULL")
    return flat.select(F.col("g").alias(group), F.col("x.field").alias("field"), F.col("x.p.id").alias(id_col), F.col("x.p.layer").alias("layer"))


def company_survivors(companies: DataFrame, groups: DataFrame, policy: str = "rank") -> DataFrame:
    """``skyline_survivors`` of company records under ``groups`` (rec_id, group_id)."""
    members = companies.select("rec_id", "lei", "wikidata_qid", "aliases", "source", "updated_at").join(groups, "rec_id")
    return skyline_survivors(members, "group_id", "rec_id", company_trust(F.col("source")), F.col("updated_at"), company_measures(), policy)
