import pytest

from kinspark.llm.addresses import place_of_records, readings, same_places
from kinspark.llm.match import match_sources, source_members
from kinspark.llm.names import Generic, generic_words, roman, take_apart
from kinspark.llm.edits import slips
from kinspark.llm.variants import _entries, _pairs_of_block, abbreviates, aligned, variant_members, variant_pairs

LEI = "5493001KJTIIGC8Y1R12"
#: Too few names to learn generic words from.
GENERIC = ["mining", "mng", "group", "grp", "steel", "copper", "gold", "energy"]
TRADE = Generic(GENERIC)


def brute_slips(a, b):
    d = {(i, j): max(i, j) if not i or not j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_slips_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 7))) for _ in range(2))
        for most in (1, 3):
            assert slips(a, b, most) == min(brute_slips(a, b), most + 1), (a, b, most)
    assert abbreviates("kelv", "kelvaro") and abbreviates("k", "kelvaro") and not abbreviates("kel", "kelvaro")
    assert aligned("kelvaro", "mitusa", "mitusa", "kelvrao", False) and not aligned("kelvaro", "mitusa", "kelvro", "mitsa", False)


def test_names_are_taken_apart():
    import pyarrow as pa

    names = ["Kelvaro & Mitusa Mining Group Inc.", "Mitusa, Kelvaro Mng Grp", "KelvaroMitusa II Ltd", "ＫＥＬＶＡＲＯ Mitusа (ABCD)", "nan", None, "Inc.", ""]
    n = len(names)
    null = pa.nulls(n, pa.string())
    rows = take_apart(TRADE, pa.array(range(n), pa.int64()), pa.array(["US"] * n), pa.array(names), null, null).to_pylist()
    assert [(r["rec_id"], r["words"], r["num"]) for r in rows] == [(0, "kelvaro mitusa", ""), (1, "kelvaro mitusa", ""), (2, "kelvaro mitusa", "2"), (3, "kelvaro mitusa", "")]


ONE = [
    {"rec_id": 1, "name": "Kelvaro Mitusa Mining Inc.", "country": "US", "source": "GLEIF", "lei": LEI},
    {"rec_id": 2, "name": "Kelvaro Mitusa Mining Incorporated", "country": "usa", "source": "Wikidata"},
    {"rec_id": 3, "name": "Kevlaro & Mitusa Mng", "country": "US", "source": "ASX"},
    {"rec_id": 4, "name": "Mitusa, Kelvaro Mining", "country": "US", "source": "gleif "},
    {"rec_id": 5, "name": "Kelv-Mitusa", "country": "US", "source": "LSE", "aliases": "['Kelvaro Mitusa Mining']"},
    {"rec_id": 6, "name": "KelvaroMitusa Mining Inc", "country": None, "city": "Wilmarsh", "source": None},
    {"rec_id": 7, "name": "Kelvaro Mitusa Mining Inc.", "country": "GB", "source": "LSE"},  # a namesake
    {"rec_id": 8, "name": "Kelvaro Mitusa Mining II Inc.", "country": "US", "source": "LSE"},  # a sister
    {"rec_id": 9, "name": None, "country": "US", "source": "LSE"},
    {"rec_id": 10, "name": "", "country": None, "source": "LSE"},
    {"rec_id": 11, "name": "Wapobe Lusanu Steel Ltd", "country": "US", "city": "Wilmarsh", "source": "TSX"},
    {"rec_id": 12, "name": "Kelvaro Mitusa Mining Inc.", "country": "US", "source": "TSX", "lei": f"LEI {LEI.lower()}"},
]


def test_variants(companies, country_aliases, generic=GENERIC):
    got = {(r["rec_id_a"], r["rec_id_b"]) for r in variant_pairs(companies(*ONE), country_aliases, generic=GENERIC).collect()}
    same = [1, 2, 3, 4, 5, 6, 12]
    expected = {(a, b) for a in same for b in same if a < b} - {(1, 12)}  # of one name
    assert got == expected
    assert variant_pairs(companies(*ONE).limit(0), country_aliases, generic=GENERIC).count() == 0


def test_sources(companies, country_aliases, generic=GENERIC):
    rows = {(r["rec_id_a"], r["rec_id_b"]): r["confidence"] for r in match_sources(companies(*ONE), country_aliases, generic=GENERIC).collect()}
    same = {1: "g", 2: "w", 3: "a", 4: "g", 5: "l", 12: "t"}
    expected = {(a, b) for a in same for b in same if a < b and same[a] != same[b]} - {(1, 12)}  # of one LEI
    assert set(rows) == expected and all(0.5 <= c <= 1 for c in rows.values())
    assert match_sources(companies(*ONE).limit(0), country_aliases, generic=GENERIC).count() == 0


SHAPES = {
    # written, again, whether they are one company
    "a short core": ("BHP Group Limited", "BHP Group Ltd", True),
    "one word": ("Microsoft Corporation", "Microsfot Corp", True),
    "one short word": ("Apex Mining Ltd", "Apax Mining Ltd", False),
    "one word in two trades": ("Apex Mining Ltd", "Apex Steel Ltd", False),
    "four words": ("Northern Star Coastal Bakery Inc", "Northern Star Coastal Bakrey Inc", True),
    "four words, a blank": ("Northern Star Coastal Bakery Inc", "Northern Star Coast al Bakery Inc", True),
    "five words, turned": ("Deep Yellow Blue Ribbon Canyon Corp", "Blue Ribbon Canyon, Deep Yellow Corp", True),
    "three words": ("Alpha Bravo Charlie Inc", "Alpha Bravo Delta Inc", False),
    "years": ("Target Retirement 2020 Fund", "Target Retirement 2030 Fund", False),
    "second numbers": ("Alpha Series 2 Fund 3", "Alpha Series 2 Fund 4", False),
    "Roman numerals": ("Alpha Bravo V", "Alpha Bravo X", False),
    "Roman and Arabic": ("Alpha Bravo XIV Ltd", "Alpha Bravo 14 Ltd", True),
    "an initial": ("K. Mitusa Mining", "Kelvaro Mitusa Mining", True),
    "another initial": ("D. Mitusa Mining", "Kelvaro Mitusa Mining", False),
    "letters apart": ("Alpha Bravo S. A. R. L.", "Alpha Bravo SARL", True),
    "generic words only": ("Mining Group Ltd", "Group Mining Inc", True),
    "another script": ("三菱商事", "三菱商事 株式会社", True),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_names_of_any_shape(shape, companies, country_aliases):
    a, b, same = SHAPES[shape]
    df = companies({"rec_id": 1, "name": a, "country": "US", "source": "ASX"}, {"rec_id": 2, "name": b, "country": "US", "source": "LSE"})
    assert [tuple(r) for r in variant_pairs(df, country_aliases, generic=GENERIC).collect()] == ([(1, 2)] if same else [])
    if "initial" not in shape:  # the cascade has no rule for these
        assert [tuple(r)[:2] for r in match_sources(df, country_aliases, generic=GENERIC).collect()] == ([(1, 2)] if same else [])


def test_an_initial_of_two_companies_stands_for_none(companies, country_aliases):
    names = ["K. Mitusa Mining", "Kelvaro Mitusa Mining", "Kandor Mitusa Mining"]
    assert variant_pairs(companies(*({"rec_id": i, "name": n, "country": "US"} for i, n in enumerate(names))), country_aliases, generic=GENERIC).count() == 0


def test_generic_words_are_learnt(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("kltmnrs") + r.choice("aeiou") for _ in range(4)).capitalize()
    names = [f"{word()} {word()} Mining Ltd" for _ in range(300)] + ["Kelvaro Mitusa Ltd"] * 300
    assert generic_words(spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string")) == {"mining", "ltd"}
    assert generic_words(spark.createDataFrame([], "name string")) == frozenset()
    assert [roman(w) for w in ("i", "iv", "ix", "xiv", "xx", "xxxix", "vi", "iix", "mi", "")] == ["1", "4", "9", "14", "20", "39", "6", "", "", ""]


def test_parted_blocks_give_the_same(companies, country_aliases):
    import random

    r = random.Random(7)
    slip = lambda w: (lambda i: w[:i] + r.choice("abz") + w[i + 1 :])(r.randrange(1, len(w)))
    rows = [{"rec_id": i, "name": f"{slip('Kelvaro') if i % 3 else 'Velmora'} {slip('Mitusa') if i % 5 == 0 else 'Mitusa'} {r.choice(['Mining', 'Steel', ''])} {r.choice(['', 'Sotulu'])}", "country": "US"} for i in range(120)]
    df = companies(*rows)
    whole, parted = (variant_pairs(df, country_aliases, generic=GENERIC, hot=h) for h in (10**6, 3))
    assert whole.count() > 100 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, parted.collect()))


def test_members(companies, country_aliases):
    got = {r["rec_id"]: (r["company"], r["links"]) for r in variant_members(companies(*ONE), country_aliases, GENERIC).collect()}
    assert len({got[i][0] for i in (1, 2, 3, 4, 5, 6, 12)}) == 1 and got[1][1] == got[12][1] == 5 and got[2][1] == 6 and got[8][1] == 0 and 9 not in got
    placed = {r["rec_id"]: (r["company"], r["sources"]) for r in source_members(companies(*ONE), country_aliases, generic=GENERIC).collect()}
    assert placed[1] == placed[12] and placed[1][1] == 5 and placed[7][1] == 1 and 6 not in placed


def test_hot_name(companies, country_aliases, generic=GENERIC):
    rows = [{"rec_id": i, "name": "Kelvaro Mitusa Mining Inc." if i % 50 else f"Kelvaro Mitusa Mining Inc{' ' * (i // 50)}.", "country": "US", "source": "GLEIF"} for i in range(200)]
    got = variant_pairs(companies(*rows), country_aliases, generic=GENERIC).count()
    names = [r["name"] for r in rows]
    assert got == sum(names[i] != names[j] for i in range(200) for j in range(i + 1, 200))


def test_very_long_texts(companies, country_aliases, generic=GENERIC):
    word = "kelvaro" * 300
    rows = [{"rec_id": 1, "name": f"{word} Mitusa Mining", "country": "US", "source": "ASX"}, {"rec_id": 2, "name": f"{word}x Mitusa Mining", "country": "US", "source": "LSE"}, {"rec_id": 3, "name": word * 3, "country": "US", "address": word + " Street 5", "city": word}]
    df = companies(*rows)
    assert [tuple(r) for r in variant_pairs(df, country_aliases, generic=GENERIC).collect()] == [(1, 2)]
    assert [tuple(r)[:2] for r in match_sources(df, country_aliases, generic=GENERIC).collect()] == [(1, 2)]
    assert same_places(df).count() == 0


def test_readings():
    street = {
        "360 VIHELFEN PKY": ("360", "", "pw", "vihelfen"), "Piso 9, C/ Mamivo, 86": ("86", "", "ca", "mamivo"), "E. Zanmalo Parkway 181": ("181", "e", "pw", "zanmalo"),
        "c/o Delsotu Services, Calle Vopana 422": ("422", "", "ca", "vopana"), "9. OG, Delkello Platz 453": ("453", "", "pl", "delkello"), "Delkelloplatz 453": ("453", "", "pl", "delkello"),
        "#291, Fosivo Square 281": ("281", "", "sq", "fosivo"), "Kelvohel Centre, No 175, Tabritar Ave, Mohagu, US 24651": ("175", "", "av", "tabritar"), "Bosasistr. 91": ("91", "", "st", "bosasi"),
    }
    for text, expected in street.items():
        assert readings(text)[0][1:5] == expected, text
    assert readings(None) == readings("") == readings("  ") == [] and readings("Wilmarsh") == []


def test_places(companies):
    here = [
        {"rec_id": 1, "address": "360 Vihelfen Parkway", "city": "Wilmarsh", "postal_code": "00310"},
        {"rec_id": 2, "address": "Ste 5, No. 360 Vihelfen Pkwy", "city": "WILMARSH", "postal_code": None},
        {"rec_id": 3, "address": "Vihlefen Pky 360, Wilmarsh", "city": None, "postal_code": "00310"},
        {"rec_id": 4, "address": "360 Vihelfen Parkway", "city": "Wilmarsh", "postal_code": "00310"},
        {"rec_id": 5, "address": "361 Vihelfen Parkway", "city": "Wilmarsh"},
        {"rec_id": 6, "address": "360 Vihelfen Street", "city": "Wilmarsh"},
        {"rec_id": 7, "address": "360 Vihelfen Parkway", "city": "Sokelva"},
        {"rec_id": 8, "address": None, "city": "Wilmarsh"}, {"rec_id": 9, "address": "", "city": "Wilmarsh"}, {"rec_id": 10},
    ]
    got = {(r["rec_id_a"], r["rec_id_b"]) for r in same_places(companies(*here)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert same_places(companies(*here).limit(0)).count() == 0
    assert place_of_records(companies(*here)).count() == 7


PLACES = {
    # two addresses with city and postal code, whether they are one place
    "a short city": (("12 Vihelfen Street", "Ulm", None), ("Vihelfen St. 12", "Ulm", "89073"), True),
    "a city of two signs": (("12 Vihelfen Street", "東京", None), ("Vihelfen St. 12", "東京", None), True),
    "namesakes": (("12 Main Street", "Paris", "75001"), ("12 Main St", "Paris", "TX-75460"), False),
    "a slip in the postal code": (("12 Main Street", "Paris", "75001"), ("12 Main St", "Paris", "75010"), True),
    "kinds": (("7 Vihelfen Crescent", "Ulm", None), ("7 Vihelfen Cres", "Ulm", None), True),
    "other kinds": (("7 Vihelfen Crescent", "Ulm", None), ("7 Vihelfen Close", "Ulm", None), False),
    "a street of a letter": (("7 Avenue B", "Ulm", None), ("Ave B 7", "Ulm", None), True),
    "a filler as city": (("7 Vihelfen Crescent", "unknown", None), ("7 Vihelfen Cres", "unknown", None), False),
}


@pytest.mark.parametrize("shape", PLACES)
def test_places_of_any_shape(shape, companies):
    a, b, same = PLACES[shape]
    rows = [dict(zip(("address", "city", "postal_code"), p, strict=True)) | {"rec_id": i} for i, p in enumerate((a, b), 1)]
    assert [tuple(r) for r in same_places(companies(*rows)).collect()] == ([(1, 2)] if same else [])


def test_beam_prefers_a_known_street(companies):
    # the plainest reading is the first part with a kind; only the second names a street that others know
    known = [{"rec_id": i, "address": f"{i} Vihelfen Street", "city": "Ulm"} for i in range(1, 40)]
    odd = {"rec_id": 99, "address": "Sotulu Court 3, Vihelfen Street 3", "city": "Ulm"}
    assert readings(odd["address"])[0][4] == "sotulu"
    assert [tuple(r) for r in same_places(companies(*known, odd)).collect()] == [(3, 99)]
    assert len(readings(", ".join(f"{i} Street{i} Road" for i in range(50)))) == 50


def test_two_slips_of_a_repeated_spelling(companies):
    rows = [{"rec_id": i, "address": "360 Vihelfenoro Parkway" + " " * i, "city": "Ulm"} for i in range(1, 9)] + [{"rec_id": i, "address": "360 Vehlefenoro Parkway" + " " * i, "city": "Ulm"} for i in (20, 21)]
    assert same_places(companies(*rows)).count() == 45


def test_all_forms_of_an_entry_are_compared(companies, country_aliases, generic=GENERIC):
    words = ["Velmont", "Vellmora", "Velmora", "Velmorra", "Velmorax"]  # one slip around the third, in any order of arrival
    names = [f"{w} Mitusa {t}" for w, t in zip(words, ("Mining", "Steel", "Copper", "Gold", "Energy"), strict=True)]
    got = {(r["rec_id_a"], r["rec_id_b"]) for r in variant_pairs(companies(*({"rec_id": i, "name": n, "country": "US"} for i, n in enumerate(names))), country_aliases, generic=GENERIC).collect()}
    assert got == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a < b}


def test_blocks_against_all_pairs():
    import random

    r = random.Random(3)
    for n in (5, 60, 300):
        for other in (["mitusa"], ["mitusa", "mitusas", "mitsa", "sotulu"]):
            words = ["velmora"] + ["".join(w[:i] + r.choice(["", c, c + w[i]]) + w[i + 1 :]) for w in r.choices(["velmora", "kelvaro"], k=n) for i, c in [(r.randrange(7), r.choice("abz"))]]
            rows = [(i, w, w, r.choice(other), 1 if len(other) > 1 else r.choice([0, 1, 2])) for i, w in enumerate(words)]
            r.shuffle(rows)

            root = {row[0]: row[0] for row in rows}
            at = {row[0]: row for row in rows}
            fits = lambda p, q: aligned(*p[2:4], *q[2:4], p[4] != 0 and p[4] == q[4])
            for a, b in _pairs_of_block(rows):
                assert fits(at[a], at[b])
                old, new = root[a], root[b]
                root = {k: new if v == old else v for k, v in root.items()}
            for p in rows:
                for q in rows:
                    meet = bool(_entries(p[1], True) & _entries(q[1], True)) if len(other) == 1 else slips(p[1], q[1], 1) <= 1 and slips(p[3], q[3], 1) <= 1
                    assert root[p[0]] == root[q[0]] or not (meet and fits(p, q)), (p, q)


def test_all_spellings_of_a_record_tie_sources(companies, country_aliases, generic=GENERIC):
    rows = [
        {"rec_id": 1, "name": "Kelvaro Mitusa Inc.", "name_norm": "sotulu wapobe", "aliases": "['Delkello Vihelfen']", "country": "US", "source": "ASX"},
        *({"rec_id": i, "name": "Sotulu Wapobe Inc.", "country": "US", "source": "LSE"} for i in (2, 3)),
        *({"rec_id": i, "name": "Delkello Vihelfen Inc.", "country": "US", "source": "TSX"} for i in (4, 5, 6)),
    ]
    got = {(r["rec_id_a"], r["rec_id_b"]) for r in match_sources(companies(*rows), country_aliases, generic=GENERIC).collect()}
    assert got == {(a, b) for a in range(1, 7) for b in range(a + 1, 7) if rows[a - 1]["source"] != rows[b - 1]["source"]}


def test_memory_of_a_block_is_bounded():
    import random
    import tracemalloc

    r = random.Random(11)
    words = ["velm" + "".join(r.choices("abcdefghiklmnoprstuvz", k=8)) for _ in range(700)]  # all meet, none is aligned
    rows = [(i, w, w, "mitusa", 0) for i, w in enumerate(words)]
    for part in (False, True):
        tracemalloc.start()
        assert not list(_pairs_of_block(rows, part))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 17e6


def test_parts_of_a_block_give_the_same():
    import random

    r = random.Random(13)
    for others in (["mitusa"], ["mitusa", "mitusas", "mitsa"]):
        words = ["".join(w[:i] + r.choice(["", c, c + w[i]]) + w[i + 1 :]) for w in r.choices(["velmora", "kelvaro", "velm"], k=200) for i, c in [(r.randrange(len(w)), r.choice("abz"))]]
        rows = [(i, w, w, r.choice(others), 1) for i, w in enumerate(words)]

        def connected(pairs):
            root = list(range(len(rows)))
            for a, b in pairs:
                root = [root[a] if x == root[b] else x for x in root]
            return {frozenset(i for i, x in enumerate(root) if x == y) for y in root}

        parts = {}
        for row in rows:
            for e in _entries(row[1], len(others) == 1):
                parts.setdefault(e, []).append(row)
        assert connected(_pairs_of_block(rows)) == connected(p for part in parts.values() for p in _pairs_of_block(part, True))


LINKED = {
    # of one spelling in two trades either may be the one that agrees
    "trades": ([{"name": "Kelvaro Mitusa Mining"}, {"name": "Kelvaro Mitusa Steel"}, {"name": "Kelvro Mitsa Mining"}, {"name": "Kelvaroo Mitussa Steel"}], [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]),
    "a mistyped alias": ([{"name": "Sotulu Wapobe Ltd", "aliases": "['Kelvaro Mitusa Mining']"}, {"name": "Kelvrao Mitusa Mining Inc."}], [(0, 1)]),
}


@pytest.mark.parametrize("case", LINKED)
def test_every_spelling_and_trade_is_compared(case, companies, country_aliases):
    rows, expected = LINKED[case]
    got = variant_pairs(companies(*(r | {"rec_id": i, "country": "US"} for i, r in enumerate(rows))), country_aliases, generic=GENERIC)
    assert sorted(map(tuple, got.collect())) == expected
