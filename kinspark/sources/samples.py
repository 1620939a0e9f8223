"""Small samples of every source, for trying things out and for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Well-known companies as the sources give them.
REGISTRY = [
    ("529900HNOAA1KXQJUQ27", "Apple Inc.", "US", "Cupertino", "One Apple Park Way", "95014", "ISSUED", "RA000665", "C0806592"),
    ("549300FX7K9QRXDE7E94", "Microsoft Corporation", "US", "Redmond", "One Microsoft Way", "98052", "ISSUED", "RA000676", "600413485"),
    ("RR3QWICWWIPCS8A4S074", "Tesla, Inc.", "US", "Austin", "13101 Tesla Road", "78725", "ISSUED", "RA000665", "C3232779"),
]
KNOWLEDGE = [
    ("Q312", "Apple Inc.", "529900HNOAA1KXQJUQ27", "US", "https://www.apple.com", "AAPL", "1976", "Apple Computer", "Apple Computer, Inc.", None),
    ("Q2283", "Microsoft Corporation", "549300FX7K9QRXDE7E94", "US", "https://www.microsoft.com", "MSFT", "1975", "Microsoft Corp", "MSFT", "Microsoft"),
]
LISTINGS = [
    ("BHP", "BHP Group Limited", "AU", "ASX", "Materials"), ("RIO", "Rio Tinto Limited", "AU", "ASX", "Materials"),
    ("FMG", "Fortescue Metals Group Ltd", "AU", "ASX", "Materials"), ("NCM", "Newcrest Mining Limited", "AU", "ASX", "Materials"),
    ("AAL", "Anglo American plc", "GB", "LSE", None), ("GLEN", "Glencore plc", "GB", "LSE", None), ("ANTO", "Antofagasta plc", "GB", "LSE", None),
    ("ABX", "Barrick Gold Corporation", "CA", "TSX", None), ("FNV", "Franco-Nevada Corporation", "CA", "TSX", None),
    ("WPM", "Wheaton Precious Metals Corp.", "CA", "TSX", None),
]
#: Metals by common knowledge: name, symbol, category, cluster, unit, basis, further names.
METALS = [
    ("Platinum", "Pt", "pgm", "pgm_complex", "toz", "$/toz", ["Pt"]), ("Palladium", "Pd", "pgm", "pgm_complex", "toz", "$/toz", ["Pd"]),
    ("Gold", "Au", "precious", "porphyry_copper_chain", "toz", "$/toz", ["Au"]), ("Silver", "Ag", "precious", "lead_zinc_chain", "toz", "$/toz", ["Ag"]),
    ("Copper", "Cu", "base", "porphyry_copper_chain", "lb", "$/lb", ["Cu"]), ("Zinc", "Zn", "base", "lead_zinc_chain", "t", "$/t", ["Zn"]),
    ("Lithium", "Li", "battery", "lithium_chain", "kg", "$/kg", ["Li"]), ("Lithium carbonate", "", "battery", "lithium_chain", "kg", "$/kg", ["Li2CO3"]),
    ("Cobalt", "Co", "battery", "nickel_cobalt_chain", "lb", "$/lb", ["Co"]), ("Cobalt sulfate", "", "battery", "nickel_cobalt_chain", "kg", "$/kg", ["CoSO4"]),
    ("Neodymium", "Nd", "ree", "rare_earth_chain", "kg", "$/kg", ["Nd"]), ("Neodymium-Praseodymium", "", "ree", "rare_earth_chain", "kg", "$/kg", ["NdPr"]),
    ("Molybdenum", "Mo", "specialty", "porphyry_copper_chain", "lb", "$/lb", ["moly"]), ("Ferrochrome", "", "ferroalloy", "chrome_chain", "lb", "$/lb", ["FeCr", "ferrochromium"]),
    ("Graphite (natural)", "", "battery", "graphite_chain", "t", "$/t", ["flake graphite"]), ("Graphite (synthetic)", "", "battery", "graphite_chain", "t", "$/t", []),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "lei string, name string, country string, city string, address string, postal_code string, status string, registration_authority string, registration_id string")


def knowledge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWLEDGE, "wikidata_qid string, name string, lei string, country string, official_website string, stock_ticker string, inception string, alias1 string, alias2 string, alias3 string")


def listings(spark: SparkSession, exchange: str | None = None) -> DataFrame:
    df = spark.createDataFrame(LISTINGS, "ticker string, name string, country string, exchange string, industry string")
    return df.filter(df.exchange == exchange) if exchange else df


def metals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METALS, "name string, symbol string, category_bucket string, cluster_id string, default_unit string, default_basis string, aliases array<string>")
