"""Postal addresses of one place, joined through a gazetteer built from the data.

 1. Every address is read in all ways to understand it: which part is the street, the
    house number and the city; parts with floors, suites, buildings, care-of and
    house names are set aside. Each reading has a cost, its lack of plainness.
 2. Localities: spellings of a city are clustered on the best supported one; where
    the city is missing, it is looked up by the part of the address that names one,
    then by the postal code, then by street and number, where only one city has them.
 3. Gazetteer: the streets of the plainest reading of every address are counted by
    locality, kind and direction, and spellings are clustered within the locality: each
    joins the best supported spelling one slip away (a symmetric-delete index finds it) of
    the same kind and direction, or one two slips away that outweighs it and has a house
    number in common, or the one that its missing kind or direction leaves.
    A cluster is a street with an identifier.
 4. Beam search over the gazetteer: every reading is a partial hypothesis, which grows
    by the entries that its words may denote (as written, by a slip, by a missing kind or
    direction); the BEAM best by cost of reading less support of the entry are kept, and
    the best of them names the street. So a less plain reading wins if its street is known
    and that of the plainest isn't.
 5. Records are joined on street and house number. Units don't separate places; postal
    codes do, where both are given and more than a slip apart, as cities may be namesakes.

Scale: spellings are counted before they are compared; an index entry holds the
spellings one slip around a name in one locality, so a city with a tenth of all rows
is many entries; places are joined on their identifier.

Defined results: records without an address, a house number, a street or a locality
match nothing; fillers are missing values; records whose three fields are equal as written
(null equals null) are no pair; repeated rows are such; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.lookalike import LATIN_CYRILLIC, LATIN_GREEK
from kinspark.functions.aliases import FILLERS
from kinspark.llm.edits import deletions_of, one_slip, slips
from kinspark.llm.variants import LONG
from kinspark.session import broadcast_if_small, hash_small_partitions, materialize, release

#: Hypotheses about an address that the beam keeps, and what support takes from a reading's cost at most.
BEAM, MOST_SUPPORT = 3, 6
MAX_DEPTH = 32
#: A spelling joins another one slip away only if that has this many times its support.
CITY_RATIO = 4
#: A street's spelling joins one two slips away only if that has about this many times its support (less one, so that spellings met once may join).
STREET_RATIO = 2
#: Kinds of streets in common use and their short forms.
KINDS = {
    "av": "avenue ave av avenida avda avd aven", "bd": "boulevard blvd boul bd bvd", "dr": "drive dr drv", "rd": "road rd", "ct": "court ct crt",
    "te": "terrace ter tce terr", "pw": "parkway pkwy pky pkw", "st": "street st str strasse strase", "sq": "square sq", "ln": "lane ln la",
    "ca": "calle c cl", "pl": "plaza plz pza platz place pl praca pca pc plats", "ps": "paseo pso", "cm": "camino cno cmno", "ru": "rue rua r",
    "cs": "crescent cres crs cr", "cl": "close clo", "gr": "grove grv gro", "wy": "way wy", "hl": "hill hl", "rw": "row", "mw": "mews", "ci": "circle cir circ", "hw": "highway hwy hiway",
    "ay": "alley aly", "wk": "walk wlk", "rt": "route rte", "bt": "bulevar bulvar", "vi": "via", "co": "corso cso", "vl": "viale vle", "ul": "ulica ul ulitsa", "pr": "prospekt prosp", "gd": "gade", "vj": "vej",
    "kt": "katu", "sr": "straat", "ll": "laan", "ro": "rond", "es": "esplanade esp", "pd": "parade pde", "ht": "heights hts",
    "qu": "quai q", "ch": "chemin chem ch", "tv": "travessa trav tv", "ga": "gasse gatan", "to": "torget torg", "we": "weg", "va": "vagen", "al": "allee", "uf": "ufer",
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
COMPOUND = re.compile(r"^(.{3,}?)(strasse|strase|str|gasse|gatan|platz|weg|allee|ufer|vagen|torget)$")
DOTTED = re.compile(r"^(.{3,}?)(g|v|w|t|pl|all|uf)$")
DOTTED_KIND = {"g": "ga", "t": "to", "v": "va", "w": "we", "pl": "pl", "all": "al", "uf": "uf"}
DIRECTIONS = {"n": "n", "s": "s", "e": "e", "w": "w", "north": "n", "south": "s", "east": "e", "west": "w"}
#: Short words in names of cities.
CITY_WORDS = {"mt": "mount", "pt": "port", "pto": "puerto", "sta": "santa", "saint": "st", "sankt": "st", "skt": "st", "city": "", "n": "north", "s": "south", "nth": "north", "sth": "south"}
UNIT = re.compile(
    r"#|\b(?:floor|flr?|level|lvl|apt|apartment|ste|suite|unit|room|rm|building|bldg|etage|etg|og|stock|haus|gebaude|geb|bat|batiment|piso|planta|oficina|ofic|of|sala|andar|bloco|plan|tr|vaning)\b"
)
HOUSE = re.compile(r"\b(?:house|centre|center|tower|services|service|hall|court house)\s*$")
CARE = re.compile(r"^\s*(?:c\s*/\s*o\b|attn|care of)")
NUMBER_MARK = re.compile(r"\b(?:no|nr|nro|num|n)\b[.:]?\s*(?=\d)|\bn[ro]?\.?\s*o\.?\s*(?=\d)")
TOKEN = re.compile(r"[^\W\d_]+\.?|\d+[a-z]?\b")
_LOOKALIKE = str.maketrans({b: unicodedata.normalize("NFKD", a)[0] for a, b in LATIN_CYRILLIC + LATIN_GREEK})


def plain(text: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        if re.search("[A-Za-z]", text):
            text = text.translate(_LOOKALIKE)
        text = text.replace("ß", "ss")
    return text.lower()


def city_letters(city: str) -> str:
    """Letters of a city's name, short words written out, without what stands in parentheses."""
    words = re.findall(r"[^\W\d_]+", re.sub(r"\(.*?\)", " ", plain(city)))
    return "".join(CITY_WORDS.get(w, w) for w in words)


def _street(words: list[str]) -> tuple[str, str, str] | None:
    """(direction, kind, name) of the words of a part, or None where no name is left."""
    bare = [w.rstrip(".") for w in words]
    direction = kind = ""
    if len(bare) > 1 and bare[0] in KIND_OF and bare[0] not in ("la",):
        kind, bare = KIND_OF[bare[0]], bare[1:]
    elif len(bare) > 1 and bare[-1] in KIND_OF:
        kind, bare = KIND_OF[bare[-1]], bare[:-1]
    elif bare:
        m = COMPOUND.match(bare[-1])
        if m:
            kind, bare = KIND_OF[m[2]], [*bare[:-1], m[1]]
        elif words[-1].endswith(".") and (m := DOTTED.match(bare[-1])):
            kind, bare = DOTTED_KIND[m[2]], [*bare[:-1], m[1]]
    if len(bare) > 1 and bare[0] in DIRECTIONS:
        direction, bare = DIRECTIONS[bare[0]], bare[1:]
    name = "".join(bare)
    return (direction, kind, name) if len(name) > 2 or (kind and name) else None


def readings(address: str | None) -> list[tuple[int, str, str, str, str, str]]:
    """(cost, number, direction, kind, name, city key) by rising cost.

    The street is a part with a kind of street, else any part that is not set aside;
    the number stands in it, else alone. City key: letters of the longest part that is left.
    """
    if not address or address.strip().lower() in FILLERS:
        return []
    text = plain(address).replace("p.o ", "paseo ").replace("c/o", " c/o ").replace("c/ ", "calle ")
    parts, alone = [], []
    for raw in text.split(","):
        if CARE.match(raw) or UNIT.search(raw) or (HOUSE.search(raw) and not any(ch.isdigit() for ch in raw)):
            continue
        marked = NUMBER_MARK.sub(" ", raw)
        tokens = TOKEN.findall(marked)
        words, digits = [t for t in tokens if not t[0].isdigit()], [t for t in tokens if t[0].isdigit()]
        if not words and len(digits) == 1:
            alone.append(digits[0])
        elif words:
            parts.append((words, digits, marked))
    lettered = ["".join(CITY_WORDS.get(w.rstrip("."), w.rstrip(".")) for w in ws if len(w) > 2 or w in CITY_WORDS) for ws, _, _ in parts]
    longest = sorted(range(len(parts)), key=lambda i: -len(lettered[i]))[:2]
    out = []
    for i, (words, digits, marked) in enumerate(parts):
        street = _street(words)
        if not street:
            continue
        first = marked.split()[0].rstrip(".") == digits[0] if digits else False
        number = (digits[0] if first else digits[-1]) if digits else (alone[0] if alone else "")
        if not number:
            continue
        cost = (0 if street[1] else 4) + (0 if digits else 1) + (len(digits) > 1) + i
        out.append((cost, number.lstrip("0") or number, *street, next((lettered[j] for j in longest if j != i), "")))
    return sorted(out)


READINGS = "rec_id long, plainest boolean, cost int, number string, direction string, kind string, name string, named_city string, city string, postal string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]]) for x in READINGS.split(", ")]
    for b in batches:
        rows = []
        for rec, address, city, postal in zip(*[c.to_pylist() for c in b.columns], strict=True):
            city_key = city_letters(city) if city and city.strip().lower() not in FILLERS else ""
            postal_key = re.sub(r"^[A-Z]{2}-|(?<=\d{5})-\d{4}$|[^A-Z0-9]+", "", postal.strip().upper()) if postal and postal.strip().lower() not in FILLERS else ""
            rows += [(rec, i == 0, *r, city_key, postal_key) for i, r in enumerate(readings(address))]
        yield pa.RecordBatch.from_pylist([dict(zip([f for f, _ in fields], r, strict=True)) for r in rows], schema=pa.schema(fields))


def _deletions_sql(column: str) -> str:
    return f"array_distinct(concat(array({column}), transform(sequence(1, length({column})), i -> concat(substring({column}, 1, i - 1), substring({column}, i + 1)))))"


def _better_cities(counted: DataFrame) -> DataFrame:
    """(city, better): each spelling's best supported neighbour one slip away that outweighs it CITY_RATIO times; ties go to the greater spelling.

    Only spellings of four letters or more have slips. A key is shared by the spellings
    around one name, of which there are no more than letters of the alphabet a place.
    """
    keyed = counted.filter("length(city) > 3").select("city", "support", F.explode(F.expr(_deletions_sql("city"))).alias("key"))
    other = keyed.select("key", F.col("city").alias("better"), F.col("support").alias("weight"))
    near = keyed.join(other, "key").filter((F.col("weight") >= F.col("support") * CITY_RATIO) & one_slip(F.col("city"), F.col("better")))
    return near.groupBy("city").agg(F.max_by("better", F.struct("weight", "better")).alias("better"))


def localities(read: DataFrame) -> DataFrame:
    """(rec_id, locality): the city of every record with a reading, in its best supported spelling."""
    one = read.filter("plainest").select("rec_id", "city", "postal", "named_city")
    counted = materialize(one.filter("city <> ''").groupBy("city").agg(F.count("*").alias("support")), "counted")
    known = materialize(counted.join(_better_cities(counted), "city", "left").select("city", "support", F.coalesce("better", "city").alias("locality")), "cities")
    cities = broadcast_if_small(known.select("city", "locality"))
    by_postal = one.filter("city <> '' AND postal <> ''").join(cities, "city").groupBy("postal", "locality").count()
    homes = materialize(by_postal.groupBy("postal").agg(F.max_by("locality", F.struct("count", "locality")).alias("home")), "homes")
    homes = broadcast_if_small(homes)
    with_city = one.join(cities.withColumnRenamed("locality", "own"), "city", "left").filter("own IS NOT NULL").select("rec_id", F.col("own").alias("locality"))
    lost = one.filter("city = ''")
    named = lost.join(cities.select(F.col("city").alias("named_city"), F.col("locality").alias("said")), "named_city", "left").join(homes, "postal", "left")
    found = materialize(with_city.unionByName(named.select("rec_id", F.coalesce("said", "home").alias("locality")).filter("locality IS NOT NULL")), "located")
    # what is still lost takes the only locality that has its street and number
    plain = read.filter("kind <> ''").select("rec_id", F.xxhash64("direction", "kind", "name", "number").alias("spot"))
    open_ = materialize(plain.join(found, "rec_id", "left_anti"), "open")
    spots = plain.join(open_.select("spot").distinct(), "spot", "left_semi").join(found, "rec_id")
    only = spots.groupBy("spot").agg(F.min("locality").alias("locality"), F.max("locality").alias("high")).filter("locality = high")
    told = open_.join(only, "spot").groupBy("rec_id").agg(F.min("locality").alias("locality"), F.max("locality").alias("high")).filter("locality = high")
    return found.unionByName(told.select("rec_id", "locality"))


def _better_of_block(rows: list[tuple[int, str, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(form, better form, its support, slips) for the rows (form, name, support, allowed slips) of a block.

    Rows are entered by falling support, so whatever meets a row under a deletion is
    better supported (or as well and smaller in spelling).
    """
    index: dict[str, list[tuple]] = {}
    for row in sorted(set(rows), key=lambda r: (-r[2], r[1])):
        form, name, _, most = row
        entries = {name} if len(name) > LONG else deletions_of(name)
        if most > 1 or len(name) > LONG:
            entries |= {"^" + name[:4], "$" + name[-4:]}
        met = {other for e in entries for other in index.get(e, ())}
        near = [(slips(name, other[1], most), -other[2], other[1], other[0]) for other in met if other[0] != form]
        near = [n for n in near if n[0] <= (most if -n[1] >= STREET_RATIO * row[2] - 1 else 1)]
        if near:
            cost, support, _, better = min(near)
            yield form, better, -support, cost
        for e in entries:
            index.setdefault(e, []).append(row)


def _better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The better spellings found in blocks; the rows of a block follow each other, also from batch to batch."""
    block, waiting = None, []

    def out(found: list[tuple]) -> pa.RecordBatch:
        kinds = (("form", pa.int64()), ("better", pa.int64()), ("weight", pa.int64()), ("cost", pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    for batch in batches:
        found: list[tuple] = []
        for b, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if b != block:
                if len(waiting) > 1:
                    found += _better_of_block(waiting)
                block, waiting = b, []
            waiting.append(tuple(row))
        yield out(found)
    if len(waiting) > 1:
        yield out(list(_better_of_block(waiting)))


def better_spellings(entries: DataFrame, numbers: DataFrame) -> DataFrame:
    """(form, parent): for each street spelling the best supported one a slip away, else, with a house number in common, two.

    entries: scope, name, support, form; numbers: scope, name, support, form, number.
    Blocks share the scope and the beginning or the end of the name (and the number),
    of which a slip leaves one whole.
    """
    ends = {1: F.substring("name", 1, 2), 2: F.right("name", F.lit(2))}
    keyed = lambda df, most, *more: df.select(F.explode(F.array(*[F.xxhash64(F.lit(k + 2 * most), "scope", *more, e) for k, e in ends.items()])).alias("block"), "form", "name", "support", F.lit(most).alias("most"))
    rows = keyed(entries, 1).unionByName(keyed(numbers.filter("length(name) >= 8"), 2, "number"))
    found = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_better, "form long, better long, weight long, cost int")
    return found.groupBy("form").agg(F.min_by("better", F.struct("cost", -F.col("weight"), "better")).alias("parent"))


def streets(placed: DataFrame) -> DataFrame:
    """(locality, direction, kind, name, street, support): the gazetteer; street identifies the cluster."""
    scope = ["locality", "direction", "kind"]
    form = F.xxhash64(*scope, "name")
    # other readings than the plainest are no evidence of a street, but may denote one
    numbered = placed.groupBy(*scope, "name", "number").agg(F.count_if("plainest").alias("n"))
    numbered = materialize(numbered.select(*scope, "name", "number", "n", F.xxhash64(*scope).alias("scope"), form.alias("form")), "numbers")
    counted = materialize(numbered.groupBy(*scope, "name", "scope", "form").agg(F.sum("n").alias("support")), "gazetteer")
    known = numbered.join(counted.select("form", "support"), "form")
    better = better_spellings(counted.filter("kind <> ''"), known.filter("kind <> ''")).withColumnRenamed("parent", "better")
    # a reading without a kind or direction joins the best supported street of its name
    evident = counted.filter("support > 0")
    fuller = evident.filter("kind <> '' AND direction <> ''").groupBy("locality", "kind", "name").agg(F.max_by("direction", F.struct("support", "direction")).alias("to_direction"))
    kinds = evident.filter("kind <> ''").groupBy("locality", "name").agg(F.max_by(F.struct("kind", "direction"), F.struct("support", "kind", "direction")).alias("to"))
    entry = lambda *c: F.xxhash64(*c)
    linked = (
        counted.join(better, "form", "left")
        .join(kinds, ["locality", "name"], "left")
        .join(fuller, ["locality", "kind", "name"], "left")
        .select(
            *scope, "name", "support", "form",
            F.when(F.col("kind") == "", F.when(F.col("to").isNotNull(), entry("locality", "to.direction", "to.kind", "name")))
            .when((F.col("direction") == "") & F.col("to_direction").isNotNull(), entry("locality", "to_direction", "kind", "name"))
            .otherwise(F.col("better")).alias("parent"),
        )
    )
    tree = materialize(linked.withColumn("street", F.coalesce("parent", "form")).drop("parent"), "streets")
    for _ in range(MAX_DEPTH):
        up = tree.select(F.col("form").alias("street"), F.col("street").alias("top"))
        step = materialize(tree.join(up, "street", "left").withColumn("moved", F.coalesce(F.col("top") != F.col("street"), F.lit(False))).withColumn("street", F.coalesce("top", "street")).drop("top"), "streets")
        tree = step.drop("moved")
        if step.filter("moved").isEmpty():
            return tree
    raise RuntimeError("streets did not collapse")


def place_of_records(companies: DataFrame) -> DataFrame:
    """(rec_id, street, number, postal): the place that each address denotes, and the letters and digits of its postal code."""
    hash_small_partitions(companies.sparkSession)
    written = companies.filter("address IS NOT NULL").select(F.col("rec_id").cast("long"), "address", "city", "postal_code")
    read = materialize(written.mapInArrow(_read, READINGS), "readings")
    placed = materialize(read.join(localities(read), "rec_id").select("rec_id", "plainest", "cost", "number", "direction", "kind", "name", "locality", "postal"), "placed")
    release(read)
    gazetteer = streets(placed)
    support = gazetteer.groupBy("street").agg(F.sum("support").alias("weight"))
    entries = gazetteer.join(support, "street").select(F.xxhash64("locality", "direction", "kind", "name").alias("form"), "street", F.least(F.floor(F.log2(F.col("weight") + 1)), F.lit(MOST_SUPPORT)).cast("int").alias("known"))
    hypotheses = placed.select("rec_id", "cost", "number", "postal", F.xxhash64("locality", "direction", "kind", "name").alias("form")).join(entries, "form")
    ranked = F.struct((2 * F.col("cost") - F.col("known")).alias("rank"), F.col("cost"), "street", "number", "postal")
    # the beam is an array of at most BEAM hypotheses at any time
    beam = hypotheses.groupBy("rec_id").agg(F.slice(F.sort_array(F.collect_list(ranked)), 1, BEAM).alias("beam"))
    return beam.select("rec_id", F.col("beam")[0]["street"].alias("street"), F.col("beam")[0]["number"].alias("number"), F.nullif(F.col("beam")[0]["postal"], F.lit("")).alias("postal"))


def same_places(companies: DataFrame) -> DataFrame:
    """(rec_id_a, rec_id_b): records of one place whose address, city and postal code are not all written alike."""
    places = place_of_records(companies)
    w = F.xxhash64(F.struct("address", "city", "postal_code"), F.col("address").isNull(), F.col("city").isNull(), F.col("postal_code").isNull())
    rows = materialize(companies.select(F.col("rec_id").cast("long"), w.alias("w")).join(places, "rec_id").select("rec_id", F.xxhash64("street", "number").alias("place"), "postal", "w"), "places")
    a, b = (rows.select("place", *[F.col(c).alias(f"{c}_{k}") for c in ("rec_id", "postal", "w")]) for k in "ab")
    p, q = F.col("postal_a"), F.col("postal_b")
    one = (p == q) | one_slip(p, q) | (F.array_sort(F.split(p, "")) == F.array_sort(F.split(q, "")))
    return a.join(b, "place").filter("rec_id_a < rec_id_b AND w_a <> w_b").filter(F.coalesce(one, F.lit(True))).select("rec_id_a", "rec_id_b")
