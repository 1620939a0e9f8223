import random

import pytest
from pyspark.sql import functions as F

from kinspark.functions import identifiers, normalize, similarity
from kinspark.functions.aliases import parse_aliases


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


COMPANY = {
    "Apple Inc.": "apple", "Microsoft Corporation": "microsoft", "Acme Ltd": "acme", "Foo Bar GmbH": "foo bar", "AT&T": "at&t",
    "Foo-Bar": "foo-bar", "Test, Inc.": "test", "A.B.C. Corp": "a b c", "Café Inc": "cafe", "Zürich AG": "zurich", "  Apple   Inc  ": "apple",
    "Foo\t\nBar": "foo bar", "": "", "   ": "", "As You Like Co": "you like", "Société Générale S.A.": "societe generale s a", "Ørsted A/S": "rsted a s",
    "ﬁne Ltd": "fine", "株式会社": "", None: "",
}


def test_company_normal_form(spark):
    assert column(spark, list(COMPANY), normalize.normalize_company_name) == list(COMPANY.values())
    again = column(spark, list(COMPANY.values()), normalize.normalize_company_name)
    assert again == list(COMPANY.values())


def test_display_form(spark):
    names = {"Apple Inc.": "Apple Inc", "Tesla, Inc.": "Tesla Inc", "AT&T Corp.": "AT&T Corp", "Société Générale": "Societe Generale", None: None}
    assert column(spark, list(names), normalize.canonicalize_company_name) == list(names.values())
    assert column(spark, ["A & B-1", "Ä", "", None], normalize.is_canonical_name) == [True, False, False, False]
    assert column(spark, ["AT&T Corporation"], lambda c: normalize.company_id(c, F.lit("US"))) == ["AT&T Corporation:US"]
    assert column(spark, ["AT&T Corporation", None], lambda c: normalize.company_id(c, F.lit("US"), safe=True)) == ["AT_T_Corporation_US", "Unknown_US"]


def test_metal_names(spark):
    assert column(spark, ["APT 88.5%", "Pt/Pd", None], normalize.normalize_metal_name) == ["apt 88 5%", "pt/pd", ""]
    assert column(spark, ["Lithium Carbonate", "FeCr HC 65%", "Pt/Pd"], normalize.slugify_metal_name) == ["lithium-carbonate", "fecr-hc-65", "ptpd"]
    titles = ["graphite (natural)", "neodymium-praseodymium", "li2co3 o'neil"]
    assert column(spark, titles, normalize.title_metal_name) == [t.title() for t in titles]
    assert column(spark, ["Platinum"], normalize.metal_id) == ["8634f7975b217e5d"]
    assert column(spark, ["lithium:carbonate", "pt"], normalize.form_hint) == ["carbonate", None]


def test_identifiers(spark):
    good = "5493001KJTIIGC8Y1R12"
    forms = [good, good.lower(), "LEI: 5493 001K JTII GC8Y 1R12", good[:-1] + "3", "0" * 20, "PENDING", "", None]
    assert column(spark, forms, identifiers.usable_lei) == [good, good, good, None, None, None, None, None]
    qids = ["Q42", " q42 ", "http://kb.example/entity/Q42", "wd:Q42", "Q0", "Q", "none", None]
    assert column(spark, qids, identifiers.usable_qid) == ["Q42"] * 4 + [None] * 4


def test_alias_notations(spark):
    texts = ["['A b', \"O'C\"]", '["X", "X"]', "A|B", "A; B", "nan", "[]", "", None, "One"]
    assert column(spark, texts, parse_aliases) == [["A b", "O'C"], ["X", "X"], ["A", "B"], ["A", "B"], [], [], [], [], ["One"]]


GOLDEN = [
    (similarity.ratio, "this is a test", "this is a test!", 96.5517), (similarity.partial_ratio, "this is a test", "this is a test!", 100),
    (similarity.token_sort_ratio, "fuzzy was a bear", "fuzzy fuzzy was a bear", 84.2105), (similarity.token_set_ratio, "fuzzy was a bear", "fuzzy fuzzy was a bear", 100),
    (similarity.weighted_ratio, "this is a test", "this is a new test!!!", 85.5), (similarity.weighted_ratio, "this is a test", "this is a new test", 95),
    (similarity.weighted_ratio, "", "a", 0),
]


@pytest.mark.parametrize("f,a,b,score", GOLDEN)
def test_similarity(f, a, b, score):
    assert f(a, b) == pytest.approx(score, abs=1e-3)
    assert f(b, a) == pytest.approx(score, abs=1e-3)


def test_native_ratio_is_the_ratio(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcd ", k=r.randint(0, 20))) for _ in range(60)]
    pairs = list(zip(words[::2], words[1::2], strict=True))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", similarity.ratio_expr(F.col("a"), F.col("b")).alias("s"), similarity.weighted_ratio_udf("a", "b").alias("w")).collect()
    for row in got:
        assert row["s"] == pytest.approx(similarity.ratio(row["a"], row["b"]))
        assert row["w"] == pytest.approx(similarity.weighted_ratio(row["a"], row["b"]))
