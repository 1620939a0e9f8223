import json

import pytest
from pyspark.sql import functions as F

from kinspark import api
from kinspark.operators import classify, countries, dedupe, extract_companies, extract_metals, link, metals, profile, resolve
from kinspark.plans import consolidate
from kinspark.sources import exchanges, knowledge, registry, samples
from kinspark.streaming import merge


@pytest.fixture(scope="module")
def catalogue(spark):
    listings = [(x, samples.listings(spark, x)) for x in ("ASX", "LSE", "TSX")]
    return consolidate.consolidate([("GLEIF", samples.registry(spark)), ("Wikidata", samples.knowledge(spark)), *listings]).cache()


@pytest.fixture(scope="module")
def metal_catalogue(spark):
    return metals.build_metals(samples.metals(spark)).cache()


def test_consolidation_of_the_samples(catalogue):
    counts = {r["source"]: r["count"] for r in catalogue.groupBy("source").count().collect()}
    assert counts == {"GLEIF": 3, "ASX": 4, "LSE": 3, "TSX": 3}
    leis = [r["lei"] for r in catalogue.filter("lei IS NOT NULL").collect()]
    assert len(set(leis)) == len(leis) == 3
    assert catalogue.columns == consolidate.COLUMNS


RESOLVED = [
    ("Apple", None, "Apple Inc", 100, "auto_high_conf"), ("Apple Computer", None, "Apple Inc", 91, "auto_high_conf"), ("BHP", "AU", "BHP Group Limited", 100, "auto_high_conf"),
    ("Anglo American", None, "Anglo American plc", 100, "auto_high_conf"), ("AAL", None, "Anglo American plc", 100, "auto_high_conf"), ("Tesla Motors", None, "Tesla Inc", 91, "auto_high_conf"),
    ("Fortescue", None, "Fortescue Metals Group Ltd", 90, "auto_high_conf"), ("Franco Nevada", None, "Franco-Nevada Corporation", 92.3077, "auto_high_conf"),
    ("Unknown XYZ", None, "Antofagasta plc", 45, "needs_hint_or_llm"), ("Rio Tinto", "US", "Microsoft Corporation", 36.3333, "needs_hint_or_llm"),
]


def test_resolution(spark, catalogue):
    asked = spark.createDataFrame([(i, n, c) for i, (n, c, *_) in enumerate(RESOLVED)], "query_id long, name string, country string")
    got = resolve.resolve(asked, catalogue).orderBy("query_id").collect()
    for row, (name, _, best, score, decision) in zip(got, RESOLVED, strict=True):
        assert (row["matches"][0]["name"], row["decision"]) == (best, decision), name
        assert row["matches"][0]["score"] == pytest.approx(score, abs=1e-3)
        scores = [m["score"] for m in row["matches"]]
        assert scores == sorted(scores, reverse=True) and len(scores) <= 5
        assert (row["final"] is None) == (decision != "auto_high_conf")


def test_empty_query_and_tiebreak(spark, catalogue):
    asked = spark.createDataFrame([(0, "", None), (1, "Barrick Goldd Mine", None)], "query_id long, name string, country string")
    got = {r["query_id"]: r for r in resolve.resolve(asked, catalogue, tiebreak=lambda matches, query: matches[-1]).collect()}
    assert got[0]["matches"][0]["score"] == 1.0 and got[0]["decision"] == "needs_hint_or_llm"
    assert got[1]["decision"] in ("llm_tiebreak", "auto_high_conf")
    assert api.company_identifier(spark, catalogue, "BHP", "AU") == "BHP Group Limited:AU"
    assert api.company_identifier(spark, catalogue, "Unknown XYZ") is None
    assert [r["name"] for r in resolve.list_companies(catalogue, "gb", "an", 1).collect()] == ["Anglo American plc"]


def test_metals(spark, metal_catalogue):
    expected = {
        "Pt": "Platinum", "PT": "Platinum", "Cu": "Copper", "moly": "Molybdenum", "ferrochromium": "Ferrochrome", "lithium:carbonate": "Lithium carbonate",
        "cobalt:sulfate": "Cobalt sulfate", "lithium": "Lithium", "neodymium praseodymium": "Neodymium-Praseodymium", "graphite": "Graphite (natural)",
        "unobtainium": None, "FeCr": None, "": None,
    }
    asked = spark.createDataFrame(list(enumerate(expected)), "query_id long, name string")
    got = {r["query_id"]: r["name"] for r in metals.resolve_metals(asked, metal_catalogue).select("query_id", "name").collect()}
    assert [got.get(i) for i in range(len(expected))] == list(expected.values())
    aliases = metals.resolve_metals(spark.createDataFrame([(0, "FeCr alloy")], "query_id long, name string"), metal_catalogue, 80, block_on_aliases=True)
    assert aliases.first()["name"] == "Ferrochrome"
    top = api.match_metal(spark, metal_catalogue, "graphite", 5)
    assert [m["name"] for m in top] == ["Graphite (natural)", "Graphite (synthetic)"] and all(0 <= m["score"] <= 100 for m in top)
    assert metals.list_metals(metal_catalogue, category="ree").count() == 2
    assert api.metal_identifier(spark, metal_catalogue, "Pt")["metal_id"] == "8634f7975b217e5d"


def test_metal_validation_and_yaml(spark, metal_catalogue, tmp_path):
    clusters = metal_catalogue.select("cluster_id").distinct().filter("cluster_id <> 'pgm_complex'")
    bad = metal_catalogue.unionByName(metal_catalogue.filter("name = 'Gold'")).withColumn("default_basis", F.when(F.col("name") == "Zinc", "$/kg").otherwise(F.col("default_basis")))
    found = {(r["check"], r["key"]) for r in profile.validate_metals(bad, clusters, ["name", "default_unit"]).collect()}
    assert ("duplicate metal_id", "gold") in found and ("unknown cluster", "platinum") in found and ("unit outside basis", "zinc") in found
    (tmp_path / "m.yaml").write_text('metals:\n  - name: "Tin"\n    symbol: "Sn"\n    category_bucket: base\n    cluster_id: c\n    default_unit: t\n    default_basis: $/t\n    aliases: ["stannum"]\n    sources: ["X"]\n')
    row = metals.build_metals(metals.metals_of_yaml(spark, str(tmp_path / "m.yaml"))).first()
    assert (row["metal_key"], row["alias1"], row["alias2"], row["formula"], row["source_priority"]) == ("tin", "stannum", "", "", "X")


def test_countries(spark):
    names = ["US", "USA", "DEU", "United Kingdom", "Holland", "England", "Untied States", "UsA", "México", "Deutschland", "Kosovo", "ZZZ_INVALID_XYZ", "", None]  # the last three have none
    codes = ["US", "US", "DE", "GB", "NL", "GB", "US", "US", "MX", "DE", "XK", None, None, None]
    assert api.country_identifiers(spark, names) == codes
    assert api.country_identifiers(spark, ["Afghanistan", "Germany"], "numeric") == ["004", "276"]
    assert api.country_identifiers(spark, ["Germany"], "ISO3") == ["DEU"]
    assert api.country_identifier(spark, "Kosovo", allow_user_assigned=False, fuzzy=False) is None
    assert api.country_identifiers(spark, []) == []


def test_link(spark):
    registry_rows = samples.registry(spark).unionByName(spark.createDataFrame([("X" * 20, "Anglo American PLC", "GB")], "lei string, name string, country string"), allowMissingColumns=True)
    listings = spark.createDataFrame([("AAL", "Anglo American plc", "GB"), ("AP", "Apple Incorporated", "US"), ("ZZ", "Qqqq Wwww", "US"), ("N", None, "US")], "ticker string, name string, country string")
    got = {r["ticker"]: (r["match_name"], r["match_type"]) for r in link.link(listings, registry_rows, "lei").collect()}
    assert got == {"AAL": ("Anglo American PLC", "exact"), "AP": ("Apple Inc.", "fuzzy")}
    q = profile.link_quality(link.link(listings, registry_rows, "lei"), listings).first()
    assert (q["exact"], q["fuzzy"], q["matched"], q["rate"]) == (1, 1, 2, 0.5)
    assert link.matched_rows(registry_rows, link.link(listings, registry_rows, "lei"), "lei").count() == 2


def test_merge_and_new_rows(spark, catalogue):
    new = catalogue.filter("source = 'ASX'").limit(1).withColumn("source", F.lit("Other")).withColumn("city", F.lit("Perth"))
    name = new.first()["name"]
    assert consolidate.update(catalogue, new).filter(F.col("name") == name).first()["city"] == "Perth"
    assert consolidate.update(catalogue, new, respect_priority=True).filter(F.col("name") == name).first()["city"] is None
    existing = catalogue.withColumn("aliases", F.array("alias1"))
    asked = spark.createDataFrame([("BHP", "Other name"), ("ZZZ", "Glencore plc"), ("QQQ", "Brand New"), (None, "Newer")], "ticker string, name string")
    fresh = dedupe.new_rows(asked, existing, F.lower("name"), F.lower("name"))
    assert {r["name"] for r in fresh.collect()} == {"Brand New", "Newer"}
    assert {r["name"] for r in dedupe.known_rows(asked, existing, F.lower("name"), F.lower("name")).collect()} == {"Other name", "Glencore plc"}
    assert dedupe.seeded_sample(catalogue, "name", 3).count() == 3


def test_streamed_merge(spark, catalogue, tmp_path):
    catalogue.limit(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(catalogue.schema).parquet(str(tmp_path / "in"))
    merge.merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    catalogue.write.mode("append").parquet(str(tmp_path / "in"))
    merge.merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert merge.latest(spark, str(tmp_path / "out")).count() == catalogue.count()


def test_company_mentions(spark, catalogue):
    text = "The deal between Acme Steel Inc. and Rio Tinto Limited in Australia. Barrick Gold said so."
    docs = spark.createDataFrame([(1, text), (2, "Apple and Microsoft lead tech. BHP operates in Australia."), (3, None), (4, "")], "doc_id long, text string")
    got = extract_companies.document_mentions(docs, "doc_id", "text").collect()
    assert all(text[r["start"] : r["stop"]].strip() == r["mention"] for r in got) and {r["doc_id"] for r in got} == {1}
    assert "Barrick Gold" in {r["mention"] for r in got}
    hints = docs.select("doc_id", extract_companies.inferred_country(F.col("text")).alias("c")).orderBy("doc_id").collect()
    assert [r["c"] for r in hints] == ["AU", "AU", None, None]
    found = extract_companies.document_companies(docs.withColumn("text", F.replace("text", F.lit("Australia"), F.lit("there"))), catalogue, "doc_id", "text").collect()
    assert "Barrick Gold Corporation" in {r["company"] for r in found}


def test_metal_mentions(spark):
    texts = {
        1: "The Pt/Pd ratio, Ni-Co laterites, and Cu/Au/Ag deposits are important.",
        2: "APT 88.5% is trading at $320/mtu while lithium carbonate demand grows.",
        3: "a few fevers in the chapter", 4: "99.5% copper and (Au), price for Ag", 5: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = extract_metals.document_metals(docs, "doc_id", "text", "c").collect()
    by = lambda i: {(r["query"], r["hint"]) for r in got if r["doc_id"] == i}
    assert {("apt", "trade_spec"), ("lithium carbonate", "chemical_form")} <= by(2)
    assert {("ferrotungsten", "chemical_form"), ("ferrovanadium", "chemical_form"), ("apt", "trade_spec")} <= by(3)
    assert {("copper", "purity_spec"), ("copper", "name")} <= by(4)
    assert {("au", "symbol"), ("ag", "symbol")} <= by(4)
    assert ("pt/pd", "symbol_combination") in by(1)
    assert api.extract_metal_pairs(spark, texts[1]) == [("pt", "pd"), ("ni", "co"), ("cu", "au")]
    lines = ["lithium-ion cells", "autocatalyst", "rare earth", "nothing", None]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", extract_metals.text_category(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["battery", "pgm", "ree", None, None]


def test_sources(spark, tmp_path):
    page = {"data": [{"attributes": {"lei": "L1", "entity": {"legalName": {"name": "A"}, "legalAddress": {"country": "US", "addressLines": ["1 Road", "Floor 2"]}, "status": "ACTIVE"}}}, {"attributes": {"lei": "L2"}}]}
    (tmp_path / "pages").mkdir()
    for i in range(3):
        (tmp_path / "pages" / f"page_{i}.json").write_text(json.dumps(page))
    assert registry.read_pages(spark, str(tmp_path / "pages")).filter("address = '1 Road Floor 2'").count() == 3
    assert registry.read_paged(spark, str(tmp_path / "pages")).count() == 6
    assert registry.read_paged(spark, str(tmp_path / "pages"), 2).count() == 2
    (tmp_path / "l1.csv").write_text("LEI,Entity.LegalName,Entity.LegalAddress.AddressLine1\nL,N,Road 1\n")
    row = registry.read_level1(spark, str(tmp_path / "l1.csv")).first()
    assert (row["lei"], row["name"], row["address"], row["country"]) == ("L", "N", "Road 1", None)
    bindings = {"results": {"bindings": [{"company": {"value": "http://kb/entity/Q312"}, "companyLabel": {"value": "A"}, "aliases": {"value": "x|y"}}, {"company": {"value": "invalid"}}]}}
    (tmp_path / "b.json").write_text(json.dumps(bindings))
    rows = knowledge.read_bindings(spark, str(tmp_path / "b.json")).orderBy("wikidata_qid").collect()
    assert [(r["wikidata_qid"], r["aliases"], r["lei"]) for r in rows] == [("", [], ""), ("Q312", ["x", "y"], "")]
    (tmp_path / "asx.csv").write_text("ASX listed companies\n\nCompany name,ASX code,GICS industry group\nBHP Group,BHP,Materials\nNo Ticker,nan,x\nAgain,BHP,y\n")
    assert [(r["ticker"], r["name"], r["industry"]) for r in exchanges.read_listing(spark, str(tmp_path / "asx.csv"), "ASX", "AU").collect()] == [("BHP", "BHP Group", "Materials")]
    (tmp_path / "lse.html").write_text("<table><tr><td>x</td></tr></table><table><tr><th>Company</th><th>EPIC</th></tr><tr><td>Anglo <b>American</b></td><td>AAL</td></tr></table>")
    lse = exchanges.read_listing(spark, str(tmp_path / "lse.html"), "LSE", "GB", "html")
    assert [(r["ticker"], r["name"], r["country"]) for r in lse.collect()] == [("AAL", "Anglo American", "GB")]
    assert exchanges.union_listings([lse, samples.listings(spark)]).count() == 11


def test_dump_query(spark):
    entities = spark.createDataFrame([("Q1", "A"), ("Q2", "B"), ("Q3", "C")], "qid string, name string")
    facts = spark.createDataFrame([("Q1", "country", "US"), ("Q1", "inception", "1976-04-01"), ("Q2", "dissolved", "2000-01-01"), ("Q3", "country", "DE")], "qid string, property string, value string")
    labels = spark.createDataFrame([("Q1", "b"), ("Q1", "a"), ("Q1", "a")], "qid string, alias string")
    got = knowledge.companies_of_dump(entities, facts, labels).collect()
    assert [(r["qid"], r["country"], r["inception"], r["aliases"]) for r in got] == [("Q1", "US", 1976, "a|b"), ("Q3", "DE", None, None)]
    assert knowledge.companies_of_dump(entities, facts, labels, countries=["DE"], include_dissolved=True).count() == 1


def test_classification(spark, catalogue, tmp_path):
    cache_rows = [("BHP Group Limited|AU", True, "supply", "", 0.9, "high", ["mining"])]
    cache = spark.createDataFrame(cache_rows, classify.RESULT)

    def model(pdf):
        if (pdf["name"] == "broken").any():
            raise ValueError
        return pdf[["key"]].assign(is_relevant=pdf["name"].str.contains("Gold|Metals"), category="supply", reasoning="", confidence=0.8, metal_intensity="", key_activities=[[] for _ in range(len(pdf))])

    kept, fresh = classify.classify_cached(catalogue, cache, model)
    names = {r["name"] for r in kept.collect()}
    assert names == {"BHP Group Limited", "Fortescue Metals Group Ltd", "Barrick Gold Corporation", "Wheaton Precious Metals Corp"} and fresh.count() == 12
    broken, none = classify.classify_cached(spark.createDataFrame([("broken", "US")], "name string, country string"), cache, model)
    assert broken.count() == 0 and none.count() == 0
    (tmp_path / "cache.json").write_text(json.dumps({"A|US": {"is_relevant": True, "category": "supply", "confidence": 0.9, "key_activities": ["x"]}}))
    assert classify.read_cache(spark, str(tmp_path / "cache.json")).first()["key"] == "A|US"
    sector = classify.matches_sector(catalogue, ["bhp"], ["gold", "mining"], {"naics": ["21"]})
    assert {r["name"] for r in catalogue.filter(sector).collect()} == {"BHP Group Limited", "Barrick Gold Corporation", "Newcrest Mining Limited"}
    prompt = catalogue.select(classify.prompts(catalogue, "{name} in {country}{industry}").alias("p")).filter("p LIKE 'BHP%'").first()["p"]
    assert prompt == "BHP Group Limited in AU"


def test_profiles_and_writing(spark, catalogue, tmp_path):
    assert profile.value_counts(catalogue, "source").first()["count"] == 4
    assert profile.top_shares(catalogue, "country", 1).first()["percent"] == pytest.approx(30.8)
    got = {r["field"]: r["filled"] for r in profile.coverage(catalogue, ["lei", "alias1"]).collect()}
    assert got == {"lei": 3, "alias1": 10}
    assert profile.distinct_counts(catalogue, ["country"]).first()["distinct"] == 4
    assert "country: " in profile.render(profile.value_counts(catalogue, "country"), "Countries")
    path = str(tmp_path / "c.parquet")
    consolidate.write_catalogue(catalogue, path)
    assert consolidate.backup(spark, path, "1") and consolidate.backup(spark, str(tmp_path / "none"), "1") is None
    consolidate.write_catalogue(catalogue, str(tmp_path / "c.csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c.csv")).count() == spark.read.parquet(path + ".1").count() == 13
    assert consolidate.preview(catalogue, n=5).count() == consolidate.preview(catalogue, False, 5).count() == 5


def test_empty_tables(spark, catalogue):
    none = spark.createDataFrame([], "query_id long, name string, country string")
    assert resolve.resolve(none, catalogue).count() == 0
    assert resolve.resolve(spark.createDataFrame([(0, "A", None)], none.schema), catalogue.limit(0)).first()["decision"] == "no_match"
    assert profile.coverage(catalogue.limit(0), ["lei"]).first()["filled"] == 0
    assert countries.resolve_countries(none, "name", countries.country_dimension(spark)).count() == 0


def _page(lei):
    return json.dumps({"data": [{"attributes": {"lei": lei, "entity": {"legalName": {"name": lei}, "legalAddress": {"country": "US", "city": "X", "postalCode": "1", "addressLines": ["a"]}, "status": "ACTIVE"}}}]})


def test_pages_behind_a_gap_are_read(spark, tmp_path):
    for i in (0, 1, 3, 4, 25):
        (tmp_path / f"page_{i}.json").write_text(_page(f"L{i}"))
    from kinspark.sources.registry import read_paged

    assert {r["lei"] for r in read_paged(spark, str(tmp_path)).collect()} == {"L0", "L1", "L3", "L4", "L25"}


def test_the_first_page_has_the_ticker(spark, tmp_path):
    from kinspark.sources.exchanges import read_listing

    (tmp_path / "page_1.csv").write_text("Company name,ASX code\nOther,OTH\nFirst page name,ABC\n")
    (tmp_path / "page_2.csv").write_text("Company name,ASX code\nSecond page name,ABC\n")
    got = {r["ticker"]: r["name"] for r in read_listing(spark, str(tmp_path), "ASX", "AU").collect()}
    assert got == {"ABC": "First page name", "OTH": "Other"}


def test_one_bad_row_spoils_no_other_and_none_is_classified_twice(spark, tmp_path):
    from kinspark.operators.classify import RESULT, classify_cached

    log = tmp_path / "log"

    def classifier(pdf):
        if (pdf["name"] == "bad").any():
            raise ValueError("no")
        with log.open("a") as f:
            f.writelines(f"{k}\n" for k in pdf["key"])
        return pdf[["key"]].assign(is_relevant=True, category="c", reasoning="", confidence=0.9, metal_intensity="", key_activities=[[] for _ in range(len(pdf))])

    df = spark.createDataFrame([(f"n{i}", "US") for i in range(20)] + [("bad", "US")], "name string, country string")
    kept, fresh = classify_cached(df, spark.createDataFrame([], RESULT), classifier, parallel=1)
    assert kept.count() == 20 and fresh.count() == 20
    assert len(log.read_text().split()) == 20


def test_fallback_by_words(spark, catalogue):
    from kinspark.operators.resolve import ranked_matches

    asked = spark.createDataFrame([(0, "The Tinto Rio", None), (1, "Glemcore", None), (2, "Qqq Www", None), (3, "Glencore", None)], "query_id long, name string, country string")
    best = {f: {r["query_id"]: r["name"] for r in ranked_matches(asked, catalogue, 1, f).collect()} for f in ("all", "words", "none", "auto")}
    assert set(best["none"]) == {3} and set(best["words"]) == {0, 1, 3} and set(best["all"]) == {0, 1, 2, 3} == set(best["auto"])
    assert all(best["words"][i] == best["all"][i] for i in (0, 1, 3))


def test_thresholds_and_hints_of_resolution(spark, catalogue):
    from kinspark.operators.resolve import resolve

    asked = spark.createDataFrame([(0, "Glencore", None, "Baar")], "query_id long, name string, country string, address_hint string")
    row = resolve(asked, catalogue, sure=101.0).first()
    assert row["decision"] == "needs_hint_or_llm" and row["query"]["address_hint"] == "Baar" and resolve(asked, catalogue).first()["decision"] == "auto_high_conf"


def test_mentions_in_long_sentences(spark):
    words = "alpha beta " * 20_000
    docs = spark.createDataFrame([(1, words), (2, words + "Inc. of it"), (3, "Foo Ltd " * 20_000), (4, None), (5, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["stop"]) for r in extract_companies.document_mentions(docs, "doc_id", "text").collect()]
    assert sorted(got) == [(2, 0, len(words) + 3), (3, 0, 8 * 20_000 - 1)]


def test_mentions_at_the_ends_of_words():
    texts = {
        "A Inc Foo Inc": ["Inc Foo Inc"], "3Com Inc.": [], "x-Foo Bar Ltd.y": ["x-Foo Bar Ltd."], "Foo L.L.C. Bar": [], "Foo L.L.C.b": ["Foo L.L.C."], "éFoo Ltd": [],
        "é Foo Ltd, and Bar Company Inc of": ["Foo Ltd", "and Bar Company Inc"], "my company limited ltd. ltd plc": ["my company limited ltd", "ltd plc"], "Foo Bar BaZ": ["Foo Bar"], "The Big Cat": [], "AT&T Corp.": ["AT&T Corp"],
    }
    for text, expected in texts.items():
        assert [text[a:b] for a, b in extract_companies.mentions(text)] == expected, text
