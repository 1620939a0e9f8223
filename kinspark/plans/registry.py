"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions import normalize as n
from kinspark.functions.aliases import parse_aliases
from kinspark.functions.similarity import ratio_expr
from kinspark.operators import classify, countries, dedupe, extract_companies, extract_metals, link, metals, profile, resolve
from kinspark.plans.consolidate import consolidate, preview
from kinspark.plans.similarity_sql import weighted_ratio_ctes
from kinspark.session import materialize, read_table
from kinspark.sources import exchanges, inventory, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Names that the flagship resolves, with an optional country.
ASKED = [
    ("Apple", None), ("Apple Computer", None), ("BHP", "AU"), ("Anglo American", None), ("AAL", None), ("Tesla Motors", None), ("Fortescue", None),
    ("Franco Nevada", None), ("Unknown XYZ", None), ("Rio Tinto", "US"), ("Glencore", "GB"), ("Barrick Gold", "CA"),
]
#: Words and codes of the mining and energy sectors.
KNOWN = [
    "anglo american", "bhp", "rio tinto", "vale", "glencore", "freeport", "newmont", "barrick", "southern copper",
    "exxon", "chevron", "shell", "bp", "totalenergies", "conocophillips", "equinor", "eni", "petrobras",
]
MINING = [
    "mining", "mine", "mineral", "metals", "gold", "silver", "copper", "iron", "steel", "aluminum", "zinc", "lead", "nickel", "lithium",
    "rare earth", "coal", "diamond", "platinum", "palladium", "uranium", "exploration", "ore", "quarry", "extraction", "smelter",
    "refinery", "resources", "commodities", "cobre", "minera", "miner",
]
ENERGY = [
    "energy", "oil", "gas", "petroleum", "lng", "lpg", "pipeline", "drilling", "offshore", "onshore", "refining", "exploration", "power",
    "electric", "electricity", "utility", "utilities", "solar", "wind", "renewable", "hydro", "nuclear", "geothermal", "coal", "battery",
    "storage", "grid", "transmission",
]
CODES = {"gics": ["10", "15", "1010", "1510"], "naics": ["21", "211", "212", "213", "221", "2211", "2212"], "nace": ["B", "D", "05", "06", "07", "08", "09", "35"]}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def sample_catalogue(spark: SparkSession) -> DataFrame:
    listed = [(x, samples.listings(spark, x)) for x in ("ASX", "LSE", "TSX")]
    return materialize(consolidate([("GLEIF", samples.registry(spark)), ("Wikidata", samples.knowledge(spark)), *listed]), "catalogue")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, asked, best, score, gap, decision of the asked names."""
    asked = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(ASKED)], "query_id long, name string, country string")
    best = resolve.ranked_matches(asked, sample_catalogue(spark), 5).filter("rank = 1")
    return best.select("query_id", F.col("q_name").alias("asked"), F.col("name").alias("best"), F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"), resolve.decision(F.col("score"), F.col("gap")).alias("decision"))


def full_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of all three raw sources, written."""
    return materialize(consolidate_sources(spark, sf_dir), "catalogue")


def resolved(asked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """asked, asked_country, best, score, gap, decision of every asked name; without a best entry where the normal name is empty."""
    asked, entries = materialize(resolve.with_normal_name(asked), "asked"), materialize(resolve.search_keys(catalogue), "entries")
    best = resolve.ranked_matches(asked.filter("name_norm <> ''"), entries, 2).filter("rank = 1")
    best = best.select("query_id", F.col("name").alias("best"), "score", "gap")
    every = asked.select("query_id", F.col("name").alias("asked"), F.col("country").alias("asked_country")).join(best, "query_id", "left")
    rounded = [F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("score", "gap")]
    return every.select("asked", "asked_country", "best", *rounded, resolve.decision(F.when(F.col("best").isNotNull(), F.col("score")), F.col("gap")).alias("decision"))


LEGAL = n.LEGAL_SUFFIXES.replace("'", "''")
_NORM = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({{c}}), '\b({LEGAL})\b\.?', '', 'g'), '[^a-z0-9&\-\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_PLAIN = rf"regexp_replace(regexp_replace({{c}}, ',\s+((?:{n.DISPLAY_SUFFIXES})\.?)', ' \1', 'gi'), '\b({n.DISPLAY_SUFFIXES})\.', '\1', 'gi')"
_SHOWN = r"trim(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9\s\-&]', ' ', 'g'), '\s+', ' ', 'g'))"
_CANON = _SHOWN.format(c=_PLAIN)


def _ascii_sql(c: str) -> str:
    """What is ASCII of the compatibility decomposition of a text, by the tables of code points."""
    single, to, several = n._ascii_tables()
    keys, values = (", ".join("'" + x.replace("'", "''") + "'" for x in xs) for xs in (several, several.values()))
    spelled = f"array_to_string(list_transform(regexp_extract_all({c}, '(?s).'), lambda x: coalesce(map_extract_value(MAP {{keys: [{keys}], values: [{values}]}}, x), x)), '')".replace("MAP {keys: ", "map(").replace(", values: ", ", ").replace("}, x), x", "), x), x")
    return f"CASE WHEN regexp_full_match({c}, '[\\x00-\\x7F]*') THEN {c} ELSE regexp_replace(translate({spelled}, '{single}', '{to.replace(chr(39), chr(39) * 2)}'), '[^\\x00-\\x7F]', '', 'g') END"


def _canon_sql(c: str) -> str:
    return _SHOWN.format(c=f"({_ascii_sql(f'({_PLAIN.format(c=c)})')})")


def _norm_sql(c: str) -> str:
    return _NORM.format(c=f"({_ascii_sql(c)})")


@query(f"SELECT p_partkey, {_NORM.format(c="p_name || ', Inc. & Co'")} AS name_norm FROM part")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", n.normalize_company_name(F.concat("p_name", F.lit(", Inc. & Co"))).alias("name_norm"))


@query(f"SELECT c_custkey, {_CANON.format(c="c_name || ', Ltd. (UK)'")} AS name, regexp_full_match({_CANON.format(c='c_name')}, '[A-Za-z0-9\\s\\-&]+') AS canonical FROM customer")
def canonicalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", n.canonicalize_company_name(F.concat("c_name", F.lit(", Ltd. (UK)"))).alias("name"), n.is_canonical_name(n.canonicalize_company_name(F.col("c_name"))).alias("canonical"))


@query(
    "SELECT c_custkey, c_name || ':' || coalesce(n_name, 'XX') AS id, trim(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g'), '_') || '_' || coalesce(n_name, 'XX') AS safe_id "
    "FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
)
def company_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", n.company_id(F.col("c_name"), F.col("n_name")).alias("id"), n.company_id(F.col("c_name"), F.col("n_name"), True).alias("safe_id"))


@query(
    r"""WITH m AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9\s\-/()%]', ' ', 'g'), '\s+', ' ', 'g')) AS norm, lower(trim(p_name)) AS low FROM part)
    SELECT p_partkey, norm, trim(regexp_replace(regexp_replace(regexp_replace(low, '[\s_]+', '-', 'g'), '[^a-z0-9\-]', '', 'g'), '-+', '-', 'g'), '-') AS slug, substr(sha1(norm || '|metal'), 1, 16) AS id FROM m"""
)
def metal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_name")
    return read_table(spark, sf_dir, "part").select("p_partkey", n.normalize_metal_name(c).alias("norm"), n.slugify_metal_name(c).alias("slug"), n.metal_id(c).alias("id"))


@query(
    r"""WITH RECURSIVE pairs AS (SELECT n_nationkey, r_regionkey, CASE WHEN length(n_name) <= length(r_name) THEN n_name ELSE r_name END AS a, CASE WHEN length(n_name) <= length(r_name) THEN r_name ELSE n_name END AS b FROM nation, region),
    lcs AS (SELECT *, list_reduce(list_prepend(CAST((1 << length(a)) - 1 AS BIGINT), list_transform(string_split(b, ''), lambda ch:
        CAST(list_sum(list_transform(range(length(a)), lambda i: CASE WHEN a[i + 1] = ch THEN 1 << i ELSE 0 END)) AS BIGINT))),
        lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((CAST(1 AS BIGINT) << length(a)) - 1)) AS left_over FROM pairs)
    SELECT n_nationkey, r_regionkey, CAST(round(200.0 * (length(a) - bit_count(left_over)) / (length(a) + length(b)), 6) AS DOUBLE) AS ratio FROM lcs"""
)
def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of every nation's and every region's name, two dimensions of fixed size."""
    pairs = read_table(spark, sf_dir, "nation").join(F.broadcast(read_table(spark, sf_dir, "region")), F.lit(True))
    return pairs.select("n_nationkey", "r_regionkey", F.round(ratio_expr(F.col("n_name"), F.col("r_name")), 6).alias("ratio"))


_TRUST = "CASE source WHEN 'GLEIF' THEN 1 WHEN 'Wikidata' THEN 2 WHEN 'ASX' THEN 3 WHEN 'LSE' THEN 3 WHEN 'TSX' THEN 3 ELSE 99 END"


def _dedupe_sql(rows: str, order: str) -> str:
    return (
        f"WITH r AS ({rows}), a AS (SELECT rec_id, row_number() OVER (PARTITION BY lei ORDER BY {order}) AS k FROM r WHERE coalesce(lei, '') <> ''), "
        f"b AS (SELECT rec_id, row_number() OVER (PARTITION BY name_norm, country ORDER BY {order}) AS k FROM r WHERE coalesce(lei, '') = '') "
        "SELECT rec_id FROM a WHERE k = 1 UNION ALL SELECT rec_id FROM b WHERE k = 1"
    )


@query(_dedupe_sql("SELECT * FROM companies_filtered WHERE coalesce(name, '') <> ''", f"{_TRUST}, rec_id"))
def dedupe_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "companies_filtered").filter(dedupe.has_text(F.col("name")))
    return dedupe.dedupe_by_priority(c, [F.col("rec_id")]).select("rec_id")


_OLD = "loaded_at < TIMESTAMP '2024-06-01'"


@query(_dedupe_sql(f"SELECT *, CASE WHEN {_OLD} THEN 0 ELSE 1 END AS batch FROM companies_filtered", "batch DESC, rec_id"))
def incremental_merge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "companies_filtered")
    old = F.coalesce(F.expr(_OLD), F.lit(False))
    return dedupe.merge_incremental(c.filter(old), c.filter(~old), [F.col("rec_id")]).select("rec_id")


@query("SELECT source, count(*) AS count FROM companies_filtered WHERE source IS NOT NULL GROUP BY source")
def profile_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(read_table(spark, sf_dir, "companies_filtered"), "source")


@query("SELECT country, count(*) AS count, CAST(round(100.0 * count(*) / (SELECT count(*) FROM companies_filtered), 1) AS DOUBLE) AS percent FROM companies_filtered WHERE country IS NOT NULL GROUP BY country ORDER BY 2 DESC, 1 LIMIT 20")
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_shares(read_table(spark, sf_dir, "companies_filtered"), "country", 20)


_FIELDS = ["lei", "wikidata_qid", "aliases", "address"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS filled, CAST(round(100.0 * count({c}) / count(*), 1) AS DOUBLE) AS percent FROM companies_filtered" for c in _FIELDS))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.coverage(read_table(spark, sf_dir, "companies_filtered"), _FIELDS)


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS \"distinct\" FROM gleif_records" for c in ("lei", "country", "status")))
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(read_table(spark, sf_dir, "gleif_records"), ["lei", "country", "status"])


@query("SELECT rec_id FROM companies_filtered WHERE country = 'US' AND (contains(lower(name), 'mining') OR contains(name_norm, 'mining'))")
def list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.list_companies(read_table(spark, sf_dir, "companies_filtered"), "us", "Mining").select("rec_id")


@query(
    "SELECT source, country, count(*) AS rows, count(city) AS with_city FROM (SELECT 'GLEIF' AS source, country, city FROM gleif_records UNION ALL SELECT 'Wikidata', country, NULL FROM wikidata_companies "
    "UNION ALL SELECT exchange, country, NULL FROM exchange_listings) GROUP BY source, country"
)
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [read_table(spark, sf_dir, t).withColumn("source", s) for t, s in (("gleif_records", F.lit("GLEIF")), ("wikidata_companies", F.lit("Wikidata")), ("exchange_listings", F.col("exchange")))]
    return exchanges.union_listings(tables).groupBy("source", "country").agg(F.count("*").alias("rows"), F.count("city").alias("with_city"))


@query("SELECT lei FROM gleif_records INTERSECT SELECT lei FROM wikidata_companies WHERE lei <> ''")
def lei_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read_table(spark, sf_dir, "wikidata_companies").select("lei").filter("lei <> ''")
    return read_table(spark, sf_dir, "gleif_records").select("lei").intersect(known)


@query("SELECT trim(ticker) AS ticker, name, exchange FROM (SELECT *, row_number() OVER (PARTITION BY trim(ticker) ORDER BY exchange, name, industry) AS k FROM exchange_listings WHERE ticker IS NOT NULL AND lower(trim(ticker)) NOT IN ('', 'nan')) WHERE k = 1")
def first_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges.first_by_ticker(read_table(spark, sf_dir, "exchange_listings"), ("exchange", "name", "industry")).select("ticker", "name", "exchange")


@query(
    "SELECT lei, country, arg_min(city, k) AS city, arg_min(address, k) AS address FROM (SELECT lei, country, nullif(city, '') AS city, nullif(address, '') AS address, "
    "coalesce(name, '') || '|' || coalesce(city, '') || '|' || coalesce(address, '') AS k FROM gleif_records) GROUP BY lei, country"
)
def fill_from_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read_table(spark, sf_dir, "gleif_records")
    order = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("name", "city", "address")])
    return dedupe.fill_from_group(g, ["lei", "country"], ["city", "address"], [order])


@query("SELECT wikidata_qid, name, a AS alias FROM (SELECT wikidata_qid, name, unnest([alias1, alias2, alias3]) AS a FROM wikidata_companies) WHERE trim(a) <> ''")
def listed_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read_table(spark, sf_dir, "wikidata_companies")
    return w.select("wikidata_qid", "name", F.explode(n.listed_aliases(3)).alias("alias"))


@query("SELECT rec_id, iso2, lpad(\"numeric\", 3, '0') AS code FROM companies_filtered LEFT JOIN (SELECT DISTINCT lower(trim(alias)) AS k, iso2, \"numeric\" FROM country_aliases) ON lower(trim(country)) = k")
def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = read_table(spark, sf_dir, "country_aliases").select(n.country_key(F.col("alias")).alias("alias"), "iso2", "iso3", "numeric", F.lit(1).alias("priority")).dropDuplicates(["alias"])
    c = countries.resolve_countries(read_table(spark, sf_dir, "companies_filtered"), "country", dim, "ISO2", fuzzy=False).withColumnRenamed("code", "iso2")
    return countries.resolve_countries(c, "country", dim, "numeric", fuzzy=False).select("rec_id", "iso2", "code")


@query()
def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct way that records write a country, resolved against the country dimension."""
    said = read_table(spark, sf_dir, "companies_filtered").select("country").distinct()
    return countries.resolve_countries(said, "country", countries.country_dimension(spark))


_EXACT = (
    f"WITH g AS (SELECT lei, name, country, lower({_canon_sql('name')}) AS canon FROM gleif_records WHERE name IS NOT NULL AND country IS NOT NULL), "
    "i AS (SELECT country, canon, lei AS match_key, name AS match_name FROM (SELECT *, row_number() OVER (PARTITION BY country, canon ORDER BY lei DESC, name) AS k FROM g) WHERE k = 1), "
    f"e AS (SELECT *, lower({_canon_sql('name')}) AS canon FROM exchange_listings WHERE name IS NOT NULL AND country IS NOT NULL), "
    "m AS (SELECT e.ticker, e.name, e.country, match_key, match_name, CAST(100 AS DOUBLE) AS score, 'exact' AS match_type FROM e JOIN i USING (country, canon)) "
)


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.link_exact(read_table(spark, sf_dir, "exchange_listings"), read_table(spark, sf_dir, "gleif_records"), "lei")[0]


@query(_EXACT + "SELECT * FROM m")
def link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir).select("ticker", "name", "country", "match_key", "match_name", "score", "match_type")


@query(_EXACT + "SELECT lei, name, city FROM gleif_records WHERE lei IN (SELECT match_key FROM m)")
def matched_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows that some listing matched."""
    return link.matched_rows(read_table(spark, sf_dir, "gleif_records"), _exact(spark, sf_dir), "lei").select("lei", "name", "city")


@query(
    _EXACT + "SELECT count(*) FILTER (match_type = 'exact') AS exact, count(*) FILTER (match_type = 'fuzzy') AS fuzzy, avg(score) AS mean_score, min(score) AS least_score, "
    "count(DISTINCT match_key) AS matched, (SELECT count(*) FROM exchange_listings) AS queries, CAST(round(count(DISTINCT match_key) / (SELECT count(*) FROM exchange_listings), 4) AS DOUBLE) AS rate FROM m"
)
def link_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.link_quality(_exact(spark, sf_dir), read_table(spark, sf_dir, "exchange_listings"))


@query("SELECT lei, name, address FROM gleif_records WHERE lei IN (SELECT lei FROM gleif_records GROUP BY lei HAVING count(*) > 1)")
def duplicate_leis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.all_duplicates(read_table(spark, sf_dir, "gleif_records"), ["lei"]).select("lei", "name", "address")


@query(
    "WITH p AS (SELECT DISTINCT p_brand AS country, p_name AS name FROM part), e AS (SELECT country, array_to_string(list_reverse(string_split(name, ' ')), ' ') AS name FROM p), "
    f"i AS (SELECT country, lower({_SHOWN.format(c='name')}) AS canon, max_by(name, country || '|' || name) AS match_name FROM p GROUP BY ALL), q AS (SELECT DISTINCT country, name, lower({_SHOWN.format(c='name')}) AS canon FROM e), "
    "x AS (SELECT q.country, q.name, q.canon AS a, i.canon AS b, match_name FROM q JOIN i USING (country)), "
    f"{weighted_ratio_ctes('x')} SELECT country, name, match_name, round(score, 6) AS score, CASE WHEN exact THEN 'exact' ELSE 'fuzzy' END AS match_type FROM (SELECT x.*, CASE WHEN a = b THEN 100.0 ELSE score END AS score, a = b AS exact, "
    "row_number() OVER (PARTITION BY country, name ORDER BY a = b DESC, score DESC, country || '|' || match_name) AS k FROM x JOIN scored USING (a, b)) WHERE k = 1 AND score >= 85"
)
def link_fuzzy_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with turned words against the part names of their brand."""
    parts = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("country"), "p_name").distinct()
    index = parts.select("country", F.col("p_name").alias("name")).withColumn("key", F.concat_ws("|", "country", "name"))
    asked = parts.select("country", F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("name"))
    return link.link(asked, index, "key").select("country", "name", "match_name", F.round("score", 6).alias("score"), "match_type").distinct()


_LISTED = r"""SELECT lower(unnest(CASE WHEN aliases LIKE '[%' THEN list_transform(regexp_extract_all(aliases, '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"'), lambda x: trim(replace(substr(x, 2, length(x) - 2), '\', '')))
  ELSE list_transform(regexp_split_to_array(aliases, '[|;]'), lambda x: trim(x)) END)) AS a FROM companies_filtered WHERE aliases IS NOT NULL"""


@query(
    f"SELECT ticker, name, exchange FROM exchange_listings e WHERE NOT EXISTS (SELECT 1 FROM companies_filtered c WHERE lower(trim(c.name)) = lower(trim(e.name))) "
    f"AND NOT EXISTS (SELECT 1 FROM ({_LISTED}) WHERE a = nullif(lower(e.ticker), '') AND a NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-', 'unknown', 'pending', '[]'))"
)
def new_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = read_table(spark, sf_dir, "companies_filtered").select("name", parse_aliases(F.col("aliases")).alias("aliases"))
    key = F.lower(F.trim("name"))
    return dedupe.new_rows(read_table(spark, sf_dir, "exchange_listings"), existing, key, key).select("ticker", "name", "exchange")


@query(
    f"SELECT ticker, name, exchange FROM exchange_listings e WHERE EXISTS (SELECT 1 FROM companies_filtered c WHERE lower(trim(c.name)) = lower(trim(e.name))) "
    f"OR EXISTS (SELECT 1 FROM ({_LISTED}) WHERE a = nullif(lower(e.ticker), '') AND a NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-', 'unknown', 'pending', '[]'))"
)
def known_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = read_table(spark, sf_dir, "companies_filtered").select("name", parse_aliases(F.col("aliases")).alias("aliases"))
    key = F.lower(F.trim("name"))
    return dedupe.known_rows(read_table(spark, sf_dir, "exchange_listings"), existing, key, key).select("ticker", "name", "exchange")


_WORDS = sorted(set(MINING + ENERGY))


@query("SELECT ticker, name, exchange FROM exchange_listings WHERE " + " OR ".join([*[f"contains(lower(name), '{w}')" for w in sorted({*_WORDS, *KNOWN})], *[f"contains(lower(industry), '{w}')" for w in _WORDS]]))
def sector_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "exchange_listings")
    return e.filter(classify.matches_sector(e, KNOWN, _WORDS, CODES)).select("ticker", "name", "exchange")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN '{c}'" for c, words in extract_metals.LADDER) + " END AS category FROM documents")
def text_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", extract_metals.text_category(F.col("text")).alias("category"))


@query(
    "WITH t(term, code) AS (VALUES "
    + ", ".join(f"('{t}', '{c}')" for t, c in extract_companies.COUNTRY_TERMS.items())
    + "), v AS (SELECT doc_id, code, count(*) AS n FROM documents JOIN t ON contains(lower(text), term) GROUP BY doc_id, code), "
    "b AS (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS k FROM v) SELECT d.doc_id, b.code AS country FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id AND k = 1"
)
def text_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", extract_companies.inferred_country(F.col("text")).alias("country"))


@query()
def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_companies.document_mentions(read_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "mention", "start", "stop")


@query()
def document_metals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_metals.document_metals(read_table(spark, sf_dir, "documents"), "doc_id", "text").drop("cluster")


_PAIRED = "coalesce(applicant, '') || ': the Pt/Pd ratio, Ni-Co laterites and Cu/Au/Ag of ' || coalesce(ipc_class, '') || ' and ' || text"
_PAIR = rf"\b({extract_metals.SYMBOL})[/\-]({extract_metals.SYMBOL})\b"


@query(
    f"WITH t AS (SELECT doc_id, {_PAIRED} AS s FROM documents), p AS (SELECT doc_id, regexp_extract_all(s, '{_PAIR}', 1) AS a, regexp_extract_all(s, '{_PAIR}', 2) AS b FROM t) "
    "SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, lower(a[i]) AS first, lower(b[i]) AS second FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM p)"
)
def document_metal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of symbols in every text behind a sentence that has some."""
    return extract_metals.metal_pairs(read_table(spark, sf_dir, "documents").select("doc_id", F.expr(_PAIRED).alias("s")), "doc_id", "s")


def _source_sql(table: str, source: str, order: int, where: str = "true", **columns: str) -> str:
    given = {"country": "country"} | columns
    cells = ", ".join(f"{given.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in ("country", "lei", "wikidata_qid", *[f"alias{i}" for i in range(1, 6)], "address", "city", "postal_code"))
    return f"SELECT {_canon_sql('name')} AS name, {cells}, '{source}' AS source, {order} AS load_order FROM {table} WHERE {where}"


_ALL_SOURCES = " UNION ALL ".join([
    _source_sql("gleif_records", "GLEIF", 0, lei="lei", address="address", city="city", postal_code="postal_code"),
    _source_sql("wikidata_companies", "Wikidata", 1, lei="lei", wikidata_qid="wikidata_qid", alias1="alias1", alias2="alias2", alias3="alias3"),
    *[_source_sql("exchange_listings", x, i, f"exchange = '{x}'", alias1="ticker") for i, x in enumerate(("ASX", "LSE", "TSX"), 2)],
])
_ORDERED = f"{_TRUST}, load_order, name NULLS FIRST, country NULLS FIRST, lei NULLS FIRST, wikidata_qid NULLS FIRST, alias1 NULLS FIRST, address NULLS FIRST, city NULLS FIRST, postal_code NULLS FIRST"


@query(
    f"WITH s AS ({_ALL_SOURCES}), r AS (SELECT name, {_NORM.format(c='name')} AS name_norm, * EXCLUDE (name) FROM s WHERE coalesce(name, '') <> ''), "
    f"a AS (SELECT *, row_number() OVER (PARTITION BY lei ORDER BY {_ORDERED}) AS k FROM r WHERE coalesce(lei, '') <> ''), "
    f"b AS (SELECT *, row_number() OVER (PARTITION BY name_norm, country ORDER BY {_ORDERED}) AS k FROM r WHERE coalesce(lei, '') = '') "
    "SELECT * EXCLUDE (k, load_order) FROM a WHERE k = 1 UNION ALL SELECT * EXCLUDE (k, load_order) FROM b WHERE k = 1"
)
def consolidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of all three raw sources."""
    listed = read_table(spark, sf_dir, "exchange_listings")
    by_exchange = [(x, listed.filter(F.col("exchange") == x)) for x in ("ASX", "LSE", "TSX")]
    return consolidate([("GLEIF", read_table(spark, sf_dir, "gleif_records")), ("Wikidata", read_table(spark, sf_dir, "wikidata_companies")), *by_exchange])


def asked_metals(spark: SparkSession, more: list[str]) -> DataFrame:
    """query_id, name: every name, symbol and alias of the inventory, and more."""
    return spark.createDataFrame(list(enumerate(_asked_names(more))), "query_id long, name string")


def _resolve_sql(asked: str) -> str:
    """The best entry of the catalogue for every row of asked(name, country), by soft blocking with all entries as fallback."""
    return (
        f"WITH asked AS ({asked}), cat AS (SELECT *, row_number() OVER () AS entry FROM ({ORACLES['consolidate_sources']})), "
        f"q AS (SELECT name AS asked, country AS asked_country, {_norm_sql('name')} AS q, CASE WHEN upper(country) IN (SELECT upper(country) FROM cat) THEN upper(country) END AS scope FROM asked), "
        f"k AS (SELECT entry, name, country, name_norm, lei, unnest(list_prepend(name_norm, list_transform(list_filter([alias1, alias2, alias3, alias4, alias5], lambda x: x IS NOT NULL), lambda x: {_norm_sql('x')}))) AS key FROM cat), "
        "f AS (SELECT *, split_part(q, ' ', 1) AS first FROM q WHERE q <> ''), "
        "hit AS (SELECT DISTINCT asked, asked_country, entry FROM f JOIN k ON substr(first, 1, 3) = substr(key, 1, 3) AND starts_with(key, first) AND (scope IS NULL OR scope = upper(country)) WHERE length(first) >= 3), "
        "rest AS (SELECT f.* FROM f LEFT JOIN (SELECT DISTINCT asked, asked_country, 1 AS h FROM hit) h ON f.asked = h.asked AND f.asked_country IS NOT DISTINCT FROM h.asked_country WHERE h IS NULL), "
        "pair AS (SELECT * FROM hit UNION ALL SELECT asked, asked_country, entry FROM rest JOIN cat ON scope IS NULL OR scope = upper(cat.country)), "
        "near AS (SELECT q.asked, q.asked_country, q.q, k.* FROM pair JOIN q ON q.asked = pair.asked AND q.asked_country IS NOT DISTINCT FROM pair.asked_country JOIN k ON k.entry = pair.entry), "
        f"texts AS (SELECT q AS a, key AS b FROM near), {weighted_ratio_ctes('texts')}, "
        "total AS (SELECT asked, asked_country, entry, name, name_norm, country, least(100, coalesce(max(score), 0) + CASE WHEN upper(country) = upper(asked_country) THEN 2 ELSE 0 END + CASE WHEN coalesce(max(lei), '') <> '' THEN 1 ELSE 0 END) AS score "
        "FROM near LEFT JOIN scored ON q = a AND key = b GROUP BY asked, asked_country, entry, name, name_norm, country), "
        "ranked AS (SELECT *, row_number() OVER w AS n, score - coalesce(lead(score) OVER w, 0) AS gap FROM total WINDOW w AS (PARTITION BY asked, asked_country ORDER BY score DESC, name_norm, name, country NULLS FIRST, entry)) "
        "SELECT q.asked, q.asked_country, name AS best, CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score, CAST(round(coalesce(gap, 0), 6) AS DOUBLE) AS gap, "
        "CASE WHEN name IS NULL THEN 'no_match' WHEN score >= 88 AND gap >= 6 THEN 'auto_high_conf' ELSE 'needs_hint_or_llm' END AS decision "
        "FROM q LEFT JOIN ranked r ON n = 1 AND r.asked = q.asked AND r.asked_country IS NOT DISTINCT FROM q.asked_country"
    )


@query(_resolve_sql("SELECT DISTINCT name, nullif(country, '') AS country FROM wikidata_companies WHERE name IS NOT NULL"))
def resolve_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name and country of the knowledge base against the catalogue of all sources."""
    names = read_table(spark, sf_dir, "wikidata_companies").select("name", F.nullif("country", F.lit("")).alias("country")).distinct().filter("name IS NOT NULL")
    return resolved(names.select(F.xxhash64("name", F.coalesce("country", F.lit(""))).alias("query_id"), "name", "country"), full_catalogue(spark, sf_dir))


@query(_resolve_sql("SELECT DISTINCT name, CAST(NULL AS VARCHAR) AS country FROM exchange_listings WHERE name IS NOT NULL"))
def resolve_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct listed name against the catalogue of all sources; the country of a listing is its exchange's and not asked for."""
    names = read_table(spark, sf_dir, "exchange_listings").select("name").distinct().filter("name IS NOT NULL")
    return resolved(names.select(F.xxhash64("name").alias("query_id"), "name", F.lit(None).cast("string").alias("country")), full_catalogue(spark, sf_dir))


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _metals_sql(more: list[str]) -> str:
    """CTEs that end in ``best``(query_id, asked, q, name, category, score) of every query and metal with its first letters."""
    norm = lambda c: rf"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9\s\-/()%]', ' ', 'g'), '\s+', ' ', 'g'))"
    asked = ", ".join(f"({i}, {_quoted(x)})" for i, x in enumerate(_asked_names(more)))
    catalogue = ", ".join(f"({_quoted(m[0])}, {_quoted(m[1])}, [{', '.join(map(_quoted, m[8]))}])" for m in inventory.METALS)
    return (
        f"WITH asked0(query_id, asked) AS (VALUES {asked}), metals0(name, symbol, aliases) AS (VALUES {catalogue}), "
        f"q AS (SELECT query_id, asked, {norm("split_part(asked, ':', 1)")} AS q, nullif(CASE WHEN contains(asked, ':') THEN {norm("substr(asked, strpos(asked, ':') + 1)")} ELSE '' END, '') AS hint FROM asked0), "
        f"m AS (SELECT name, symbol, {norm('name')} AS norm, list_filter(list_transform(aliases, lambda x: {norm('x')}), lambda x: x <> '') AS others FROM metals0), "
        "near AS (SELECT query_id, asked, q, name, norm, unnest(list_prepend(norm, others)) AS t FROM q JOIN m ON (length(q) < 3 OR substr(q, 1, 3) = substr(norm, 1, 3)) AND (hint IS NULL OR contains(norm, hint)) WHERE q <> ''), "
        f"texts AS (SELECT q AS a, t AS b FROM near), {weighted_ratio_ctes('texts')}, "
        "best AS (SELECT query_id, asked, q, name, max(score) AS score FROM near JOIN scored ON q = a AND t = b GROUP BY ALL) "
    )


def _asked_names(more: list[str]) -> list[str]:
    names = dict.fromkeys(x for m in inventory.METALS for x in (m[0], m[1], *m[-1]) if x)
    return list(dict.fromkeys([*more, *names]))


ASKED_METALS = ["Pt", "Cu", "moly", "lithium:carbonate", "neodymium praseodymium", "graphite", "unobtainium", "cobalt:sulfate", "ferrochromium", "lithium carbonates", "cobalt", "tungsten ore"]


@query(
    _metals_sql(ASKED_METALS) + ", symbol AS (SELECT query_id, asked, name, CAST(100 AS DOUBLE) AS score FROM q JOIN m ON length(q) <= 3 AND q = lower(symbol)), "
    "every AS (SELECT * FROM symbol UNION ALL SELECT query_id, asked, name, score FROM best WHERE score >= 90 AND query_id NOT IN (SELECT query_id FROM symbol)) "
    "SELECT CAST(query_id AS BIGINT) AS query_id, asked, name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS k FROM every) WHERE k = 1"
)
def resolve_metals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asked_metals(spark, ASKED_METALS)
    return metals.resolve_metals(asked, metals.build_metals(inventory.metals(spark))).select("query_id", "asked", "name", F.round("score", 6).alias("score"))


@query(
    _metals_sql(ASKED_METALS) + "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(k AS INTEGER) AS rank, name, round(score, 6) AS score "
    "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS k FROM best) WHERE k <= 5"
)
def top_metals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asked_metals(spark, ASKED_METALS)
    return metals.top_metals(asked, metals.build_metals(inventory.metals(spark)), 5).select("query_id", "rank", "name", F.round("score", 6).alias("score"))


_METALS = ", ".join("(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in m[:8]) + ")" for m in inventory.METALS)


@query(
    f"WITH m(name, symbol, formula, code, category, cluster, unit, basis) AS (VALUES {_METALS}), "
    "k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[\\s_]+', '-', 'g'), '[^a-z0-9\\-]', '', 'g'), '-+', '-', 'g'), '-') AS key FROM m) "
    "SELECT 'unit outside basis' AS check, key, unit || ' / ' || basis AS detail FROM k WHERE NOT contains(lower(basis), lower(unit)) "
    "UNION ALL SELECT 'missing field', key, 'formula' FROM k WHERE formula IS NULL UNION ALL SELECT 'missing field', key, 'symbol' FROM k WHERE symbol IS NULL"
)
def validate_metals(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = metals.build_metals(inventory.metals(spark))
    return profile.validate_metals(built, built.select("cluster_id").distinct(), ["name", "formula", "symbol"])


_BY_WORD = "regexp_matches(lower(name), 'min|gold|copper')"


@query(
    f"SELECT DISTINCT name, country, CASE WHEN country = 'US' THEN 'cached' ELSE 'supply' END AS value_chain_category FROM gleif_records "
    f"WHERE coalesce(name, '') <> '' AND CASE WHEN country = 'US' THEN contains(lower(name), 'steel') ELSE {_BY_WORD} END"
)
def classify_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows: those of one country are known to the cache, the others go to a word classifier."""
    g = read_table(spark, sf_dir, "gleif_records").select("name", "country")

    def words(pdf):
        hit = pdf["name"].str.lower().str.contains("min|gold|copper", regex=True)
        return pdf[["key"]].assign(is_relevant=hit, category="supply", reasoning="", confidence=0.9, metal_intensity="", key_activities=[[] for _ in range(len(pdf))])

    known = g.filter("country = 'US'").distinct().select(
        n.cache_key(F.col("name"), F.col("country")).alias("key"), F.contains(F.lower("name"), F.lit("steel")).alias("is_relevant"), F.lit("cached").alias("category"), F.lit("").alias("reasoning"),
        F.lit(0.8).alias("confidence"), F.lit("").alias("metal_intensity"), F.array().cast("array<string>").alias("key_activities"),
    )
    return classify.classify_cached(g, known, words)[0]


@query("SELECT name, country, lei FROM (SELECT *, concat_ws('|', name, country, lei) AS k FROM companies_filtered) ORDER BY md5('42|' || k), k LIMIT 5000")
def seeded_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(read_table(spark, sf_dir, "companies_filtered").select("name", "country", "lei"))
