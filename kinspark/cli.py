"""python -m kinspark.cli COMMAND: batch jobs over files.

build    registry, knowledge base and listings (Parquet) to a catalogue
update   merges new rows into a catalogue, with a backup
expand   adds listings that a catalogue does not know yet
link     listings to registry rows
profile  counts, coverage and top countries of a catalogue
metals   a YAML of metals to a validated catalogue
extract  mentions of metals in a table of documents
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from kinspark.functions.normalize import canonicalize_company_name
from kinspark.operators import dedupe, extract_metals, link, metals, profile
from kinspark.plans import consolidate
from kinspark.session import get_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, **options) -> None:
        p = sub.add_parser(name)
        for x in paths:
            p.add_argument(x)
        for k, v in options.items():
            p.add_argument("--" + k.replace("_", "-"), default=v, type=type(v) if v is not None else str)

    command("build", "output", registry=None, knowledge=None, listings=None, form="parquet", limit=0)
    command("update", "catalogue", "new", "output", trust=0)
    command("expand", "catalogue", "listings", "output")
    command("link", "listings", "registry", "output", threshold=85.0, key="lei")
    command("profile", "catalogue")
    command("metals", "yaml", "clusters", "output")
    command("extract", "documents", "output", id="doc_id", text="text")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session(app=f"kinspark {args.command}")
    read = spark.read.parquet
    if args.command == "build":
        sources = [("GLEIF", read(args.registry))] if args.registry else []
        sources += [("Wikidata", read(args.knowledge))] if args.knowledge else []
        if args.listings:
            listed = read(args.listings)
            sources += [(x, listed.filter(F.col("exchange") == x)) for x in ("ASX", "LSE", "TSX")]
        if not sources:
            parser().error("build needs a source")
        consolidate.write_catalogue(consolidate.consolidate(sources, args.limit or None), args.output, args.form)
    elif args.command == "update":
        consolidate.backup(spark, args.output, time.strftime("%Y%m%d%H%M%S"))
        consolidate.write_catalogue(consolidate.update(read(args.catalogue), read(args.new), bool(args.trust)), args.output)
    elif args.command == "expand":
        catalogue, listed = read(args.catalogue), read(args.listings)
        known = catalogue.withColumn("aliases", F.filter(F.array(*[f"alias{i}" for i in range(1, 6)]), lambda a: a.isNotNull()))
        name = F.lower(canonicalize_company_name(F.col("name")))
        fresh = consolidate.to_catalogue(dedupe.new_rows(listed, known, name, name).withColumn("source", F.col("exchange"))).drop("load_order")
        both = catalogue.withColumn("_b", F.lit(0)).unionByName(fresh.withColumn("_b", F.lit(1)))
        consolidate.write_catalogue(dedupe.keep_first(both, ["name", "country"], [F.col("_b"), F.col("source"), F.col("alias1")]).drop("_b"), args.output)
    elif args.command == "link":
        listed = read(args.listings)
        found = link.link(listed, read(args.registry), args.key, args.threshold)
        found.write.mode("overwrite").parquet(args.output)
        print(profile.render(profile.link_quality(read(args.output), listed), "Links"))
    elif args.command == "profile":
        df = read(args.catalogue)
        for title, p in (("Sources", profile.value_counts(df, "source")), ("Countries", profile.top_shares(df, "country", 20)), ("Coverage", profile.coverage(df, ["lei", "wikidata_qid", "alias1", "address"]))):
            print(profile.render(p, title))
    elif args.command == "metals":
        built = metals.build_metals(metals.metals_of_yaml(spark, args.yaml))
        findings = profile.validate_metals(built, metals.clusters_of_yaml(spark, args.clusters), ["name", "category_bucket", "cluster_id", "default_unit", "default_basis"])
        if not findings.isEmpty():
            print(profile.render(findings, "Findings"))
            return 1
        built.write.mode("overwrite").parquet(args.output)
    elif args.command == "extract":
        extract_metals.document_metals(read(args.documents), args.id, args.text).write.mode("overwrite").parquet(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
