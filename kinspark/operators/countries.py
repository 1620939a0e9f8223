"""Country names to codes: a dimension built from the Java locale data, exact stages, a fuzzy rest."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.functions.normalize import country_key
from kinspark.functions.similarity import weighted_ratio_udf

#: Names that people use for countries beside the official ones.
COLLOQUIAL = {
    "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "holland": "NL", "ivory coast": "CI", "cote d'ivoire": "CI",
    "viet nam": "VN", "palestine": "PS", "vatican": "VA", "uae": "AE", "emirates": "AE", "burma": "MM", "kosovo": "XK",
    "usa": "US", "u.s.": "US", "u.s.a.": "US", "uk": "GB", "u.k.": "GB", "great britain": "GB", "america": "US", "united states of america": "US",
}
LANGUAGES = ("en", "de", "fr", "es", "pt", "it")


def country_dimension(spark: SparkSession) -> DataFrame:
    """(alias, iso2, iso3, numeric, priority): codes, names in several languages, colloquial names; one row an alias.

    Some 2000 rows, as many as countries and languages give.
    """
    jvm = spark._jvm
    locale, region = jvm.java.util.Locale, None
    try:
        region = jvm.com.ibm.icu.util.Region
        region.getInstance("US").getNumericCode()
    except Exception:  # noqa: BLE001
        warnings.warn("no region data for numeric codes", stacklevel=2)
        region = None
    codes = {}
    for code in locale.getISOCountries():
        here = locale("", code)
        number = f"{region.getInstance(code).getNumericCode():03d}" if region else None
        codes[code] = (here.getISO3Country(), number, [here.getDisplayCountry(locale(lang)) for lang in LANGUAGES])
    codes.setdefault("XK", ("XKX", "000", ["Kosovo"]))
    rows: dict[str, tuple] = {}
    for code, (iso3, number, names) in codes.items():
        for priority, alias in [(1, code), (1, iso3), *[(2, n) for n in names]]:
            rows.setdefault(alias.strip().lower().replace("’", "'"), (code, iso3, number, priority))
    for alias, code in COLLOQUIAL.items():
        rows.setdefault(alias, (code, codes[code][0], codes[code][1], 3))
    return spark.createDataFrame([(a, *r) for a, r in rows.items()], "alias string, iso2 string, iso3 string, numeric string, priority int")


def code_in(system: str) -> Column:
    """The code of a row of the dimension in ISO2, ISO3 or numeric, three digits."""
    name = system.lower()
    if name in ("num", "numeric"):
        return F.lpad("numeric", 3, "0")
    if name not in ("iso2", "iso3"):
        return F.lit(None).cast("string")
    return F.col(name)


def resolve_countries(df: DataFrame, column: str, dimension: DataFrame, to: str = "ISO2", fuzzy: bool = True, threshold: float = 85.0, allow_user_assigned: bool = True) -> DataFrame:
    """``df`` with ``code``: exact names and codes first, then the most similar alias from ``threshold`` on; else null.

    The dimension is bounded, so it is broadcast; the fuzzy stage sees each distinct
    unmatched text once.
    """
    dim = dimension if allow_user_assigned else dimension.filter("iso2 <> 'XK'")
    exact = dim.select(F.col("alias").alias("_key"), code_in(to).alias("code"))
    keyed = df.withColumn("_key", F.nullif(country_key(F.col(column)), F.lit("")))
    if not fuzzy:
        return keyed.join(F.broadcast(exact), "_key", "left").drop("_key")
    rest = keyed.select("_key").filter("_key IS NOT NULL").distinct().join(F.broadcast(exact), "_key", "left_anti")
    named = dimension.filter("priority > 1 AND length(alias) > 2")  # codes are not names to be similar to
    pairs = rest.join(F.broadcast(named.select("alias", "iso2", code_in(to).alias("code"))), F.lit(True))
    best = Window.partitionBy("_key").orderBy(F.desc("score"), "alias")
    scored = pairs.withColumn("score", weighted_ratio_udf("_key", "alias")).filter(F.col("score") >= threshold)
    similar = scored.withColumn("n", F.row_number().over(best)).filter("n = 1")
    if not allow_user_assigned:
        similar = similar.filter("iso2 <> 'XK'")
    both = exact.unionByName(similar.select("_key", "code"))
    return keyed.join(both, "_key", "left").drop("_key")
