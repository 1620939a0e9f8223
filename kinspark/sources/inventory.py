"""The reference inventory of metals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, symbol, formula, code, category_bucket, cluster_id, default_unit, default_basis, aliases of the 50 metals.
METALS = [
    ("Platinum", "Pt", None, None, "pgm", "pgm_complex", "toz", "$/toz", ["Pt"]),
    ("Palladium", "Pd", None, None, "pgm", "pgm_complex", "toz", "$/toz", ["Pd"]),
    ("Rhodium", "Rh", None, None, "pgm", "pgm_complex", "toz", "$/toz", ["Rh"]),
    ("Ruthenium", "Ru", None, None, "pgm", "pgm_complex", "toz", "$/toz", ["Ru"]),
    ("Iridium", "Ir", None, None, "pgm", "pgm_complex", "toz", "$/toz", ["Ir"]),
    ("Osmium", "Os", None, None, "pgm", "pgm_complex", "toz", "$/toz", ["Os"]),
    ("Gold", "Au", None, None, "precious", "porphyry_copper_chain", "toz", "$/toz", ["Au"]),
    ("Silver", "Ag", None, None, "precious", "lead_zinc_chain", "toz", "$/toz", ["Ag"]),
    ("Copper", "Cu", None, None, "base", "porphyry_copper_chain", "lb", "$/lb", ["Cu", "cathode copper"]),
    ("Molybdenum", "Mo", None, None, "specialty", "porphyry_copper_chain", "lb", "$/lb Mo", ["Mo", "moly"]),
    ("Rhenium", "Re", None, None, "specialty", "porphyry_copper_chain", "kg", "$/kg", ["Re"]),
    ("Selenium", "Se", None, None, "specialty", "porphyry_copper_chain", "lb", "$/lb", ["Se"]),
    ("Tellurium", "Te", None, None, "specialty", "porphyry_copper_chain", "lb", "$/lb", ["Te"]),
    ("Zinc", "Zn", None, None, "base", "lead_zinc_chain", "lb", "$/lb", ["Zn", "SHG zinc", "special high grade zinc"]),
    ("Lead", "Pb", None, None, "base", "lead_zinc_chain", "lb", "$/lb", ["Pb"]),
    ("Cadmium", "Cd", None, None, "specialty", "lead_zinc_chain", "lb", "$/lb", ["Cd"]),
    ("Indium", "In", None, None, "specialty", "lead_zinc_chain", "kg", "$/kg", ["In"]),
    ("Germanium", "Ge", None, None, "specialty", "lead_zinc_chain", "kg", "$/kg", ["Ge"]),
    ("Bismuth", "Bi", None, None, "specialty", "lead_zinc_chain", "lb", "$/lb", ["Bi"]),
    ("Antimony", "Sb", None, None, "specialty", "lead_zinc_chain", "lb", "$/lb", ["Sb"]),
    ("Ammonium paratungstate", None, "(NH4)10[H2W12O42]·xH2O", "WO3", "specialty", "sn_ta_nb_w_chain", "mtu", "$/mtu WO3", ["APT", "APT 88.5%"]),
    ("Ferrochrome", None, None, "FeCr", "ferroalloy", "ferroalloy_chain", "lb", "$/lb Cr", ["FeCr", "ferrochromium", "HC FeCr", "charge chrome"]),
    ("Lithium", "Li", None, None, "battery", "lithium_chain", "mt", "$/mt", ["Li", "lithium metal"]),
    ("Lithium carbonate", None, "Li2CO3", "Li2CO3", "battery", "lithium_chain", "mt", "$/mt Li2CO3", ["Li2CO3", "lithium carb", "battery grade lithium carbonate"]),
    ("Lithium hydroxide", None, "LiOH·H2O", "LiOH", "battery", "lithium_chain", "mt", "$/mt LiOH", ["LiOH", "lithium hydroxide monohydrate", "battery grade lithium hydroxide"]),
    ("Cobalt", "Co", None, None, "battery", "nickel_cobalt_chain", "lb", "$/lb", ["Co", "cobalt metal"]),
    ("Cobalt sulfate", None, "CoSO4·7H2O", "CoSO4", "battery", "nickel_cobalt_chain", "mt", "$/mt", ["CoSO4", "cobalt sulphate", "cobalt sulfate heptahydrate"]),
    ("Nickel", "Ni", None, None, "battery", "nickel_cobalt_chain", "mt", "$/mt", ["Ni", "nickel metal"]),
    ("Nickel sulfate", None, "NiSO4·6H2O", "NiSO4", "battery", "nickel_cobalt_chain", "mt", "$/mt", ["NiSO4", "nickel sulphate", "nickel sulfate hexahydrate"]),
    ("Graphite (natural)", None, "C", "C", "battery", "carbon_silicon_chain", "mt", "$/mt", ["natural graphite", "flake graphite", "spherical graphite"]),
    ("Graphite (synthetic)", None, "C", "C", "battery", "carbon_silicon_chain", "mt", "$/mt", ["synthetic graphite", "artificial graphite"]),
    ("Lanthanum", "La", None, None, "ree", "rare_earth_chain", "kg", "$/kg La2O3", ["La", "lanthanum oxide"]),
    ("Cerium", "Ce", None, None, "ree", "rare_earth_chain", "kg", "$/kg CeO2", ["Ce", "cerium oxide"]),
    ("Praseodymium", "Pr", None, None, "ree", "rare_earth_chain", "kg", "$/kg Pr6O11", ["Pr", "praseodymium oxide"]),
    ("Neodymium", "Nd", None, None, "ree", "rare_earth_chain", "kg", "$/kg Nd2O3", ["Nd", "neodymium oxide"]),
    ("Samarium", "Sm", None, None, "ree", "rare_earth_chain", "kg", "$/kg Sm2O3", ["Sm", "samarium oxide"]),
    ("Europium", "Eu", None, None, "ree", "rare_earth_chain", "kg", "$/kg Eu2O3", ["Eu", "europium oxide"]),
    ("Gadolinium", "Gd", None, None, "ree", "rare_earth_chain", "kg", "$/kg Gd2O3", ["Gd", "gadolinium oxide"]),
    ("Terbium", "Tb", None, None, "ree", "rare_earth_chain", "kg", "$/kg Tb4O7", ["Tb", "terbium oxide"]),
    ("Dysprosium", "Dy", None, None, "ree", "rare_earth_chain", "kg", "$/kg Dy2O3", ["Dy", "dysprosium oxide"]),
    ("Yttrium", "Y", None, None, "ree", "rare_earth_chain", "kg", "$/kg Y2O3", ["Y", "yttrium oxide"]),
    ("Neodymium-Praseodymium", None, "(Nd,Pr)2O3", "NdPr", "ree", "rare_earth_chain", "kg", "$/kg NdPr oxide", ["NdPr", "Nd-Pr", "didymium", "NdPr oxide"]),
    ("Ferromanganese", None, None, "FeMn", "ferroalloy", "ferroalloy_chain", "mt", "$/mt", ["FeMn", "HC FeMn", "high carbon ferromanganese"]),
    ("Ferrovanadium", None, None, "FeV", "ferroalloy", "ferroalloy_chain", "lb", "$/lb V", ["FeV", "FeV80", "ferrovanadium 80%"]),
    ("Ferrotungsten", None, None, "FeW", "ferroalloy", "sn_ta_nb_w_chain", "kg", "$/kg W", ["FeW", "FeW75", "ferrotungsten 75%"]),
    ("Ferromolybdenum", None, None, "FeMo", "ferroalloy", "porphyry_copper_chain", "lb", "$/lb Mo", ["FeMo", "FeMo60", "ferromoly"]),
    ("Tungsten", "W", None, None, "specialty", "sn_ta_nb_w_chain", "kg", "$/kg", ["W", "wolfram", "tungsten metal"]),
    ("Tantalum", "Ta", None, None, "specialty", "sn_ta_nb_w_chain", "lb", "$/lb Ta2O5", ["Ta", "tantalum pentoxide", "Ta2O5"]),
    ("Niobium", "Nb", None, None, "specialty", "sn_ta_nb_w_chain", "kg", "$/kg Nb2O5", ["Nb", "columbium", "Cb", "niobium pentoxide"]),
    ("Vanadium", "V", None, None, "specialty", "ferroalloy_chain", "lb", "$/lb V2O5", ["V", "vanadium pentoxide", "V2O5"]),
]


def metals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METALS, "name string, symbol string, formula string, code string, category_bucket string, cluster_id string, default_unit string, default_basis string, aliases array<string>")
