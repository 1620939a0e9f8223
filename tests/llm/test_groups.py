import random

from pyspark.sql import functions as F

from kinspark.llm.consolidate import components, tied_groups
from kinspark.llm.survivor import company_survivors, skyline_survivors

LEI = ["5493001KJTIIGC8Y1R12", "529900HNOAA1KXQJUQ27", "549300FX7K9QRXDE7E07"]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_against_brute_force(spark):
    r = random.Random(4)
    cases = [
        [(i, i + 1) for i in range(60)],  # a chain
        [(0, i) for i in range(1, 80)],  # a star
        [(r.randrange(200), r.randrange(200)) for _ in range(150)],
        [(5, 5), (1, 2), (2, 1), (1, 2)],  # a loop, repeats, both directions
    ]
    for edges in cases:
        got = {x["vertex"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == brute_components(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(None, 1), ("b", None)], "a string, b string")).count() == 0
    words = components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()
    assert {x["vertex"]: x["component"] for x in words} == dict.fromkeys("abc", "a")


def test_tied_groups(companies):
    rows = companies(
        {"rec_id": 9, "lei": LEI[0]}, {"rec_id": 3, "lei": f"LEI: {LEI[0].lower()}", "wikidata_qid": "Q5"}, {"rec_id": 4, "wikidata_qid": "wd:q5"},
        {"rec_id": 5, "lei": LEI[1]}, {"rec_id": 6, "lei": "00000000000000000000"}, {"rec_id": 7, "lei": "00000000000000000000", "wikidata_qid": "Q0"},
        {"rec_id": 8}, {"rec_id": 1, "lei": LEI[2]}, {"rec_id": 2, "lei": LEI[2]},
    )
    got = {r["rec_id"]: r["group_id"] for r in tied_groups(rows).collect()}
    assert got == {9: 3, 3: 3, 4: 3, 1: 1, 2: 1}
    assert tied_groups(rows.limit(0)).count() == 0


def test_hot_identifier(companies):
    rows = companies(*[{"rec_id": i, "lei": LEI[0]} for i in range(300)], *[{"rec_id": 1000 + i, "wikidata_qid": f"Q{i + 1}"} for i in range(50)])
    got = tied_groups(rows).collect()
    assert len(got) == 300 and {r["group_id"] for r in got} == {0}


def test_company_survivors(companies, spark, day):
    rows = companies(
        {"rec_id": 1, "source": "ASX", "lei": LEI[0], "aliases": "['a', 'A', 'b']", "updated_at": day(9)},
        {"rec_id": 2, "source": " gleif", "wikidata_qid": "none", "updated_at": day(1)},
        {"rec_id": 3, "source": "GLEIF", "lei": LEI[1], "updated_at": day(1)},
        {"rec_id": 4, "source": None, "wikidata_qid": "Q7", "aliases": "x|y|z"},
        {"rec_id": 5, "source": "Wikidata", "lei": LEI[2], "aliases": "x; y;z", "updated_at": day(3)},
        {"rec_id": 6, "source": "", "aliases": "nan"},
    )
    groups = spark.createDataFrame([(i, 10) for i in range(1, 6)] + [(6, 20)], "rec_id long, group_id long")
    got = {(r["group_id"], r["field"]): r["rec_id"] for r in company_survivors(rows, groups).collect()}
    assert got == {(10, "source"): 2, (10, "lei"): 3, (10, "wikidata_qid"): 4, (10, "aliases"): 5}
    assert company_survivors(rows.limit(0), groups).count() == 0


def brute_layers(points):
    """Peels the undominated points of (trust, age, id, filled) off, layer by layer."""
    beats = lambda x, y: x != y and x[0] <= y[0] and x[1:3] <= y[1:3] and x[3] >= y[3]
    left, layers, n = set(points), {}, 0
    while left:
        n += 1
        top = {p for p in left if not any(beats(q, p) for q in left)}
        layers |= dict.fromkeys(top, n)
        left -= top
    return layers


def test_skyline_against_brute_force(spark):
    r = random.Random(2)
    data = [(r.randrange(6), i, r.randint(1, 3), r.randrange(5), r.randrange(2), r.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(data, "g int, id long, trust int, t int, a int, b int")
    args = (df, "g", "id", F.col("trust"), F.timestamp_seconds(F.col("t")), {"a": F.col("a"), "b": F.col("b")})
    for policy in ("layers", "rank"):
        got = {(x["g"], x["field"]): (x["id"], x["layer"]) for x in skyline_survivors(*args, policy=policy).collect()}
        expected = {}
        for g in range(6):
            cells = {}
            for k, i, trust, t, a, b in data:
                if k == g:
                    cells[trust, a, b] = min(cells.get((trust, a, b), (99, 0)), (-t, i))
            points = {(trust, age, i, (a > 0) + (b > 0)): (a, b) for (trust, a, b), (age, i) in cells.items()}
            layers = brute_layers(points)
            for n, field in enumerate("ab"):
                best = min(((layers[p] if policy == "layers" else 0, -m[n], *p[:3], layers[p]) for p, m in points.items() if m[n]), default=None)
                if best:
                    expected[g, field] = (best[4], best[5])
        assert got == expected


def test_a_field_is_filled_from_the_second_layer(spark):
    rows = [(1, 1, 1, 9, 1, 1, 0), (1, 2, 2, 5, 0, 0, 1), (1, 3, 3, 2, 0, 0, 1)]  # each dominates the next
    df = spark.createDataFrame(rows, "g int, id long, trust int, t int, a int, b int, c int")
    for policy in ("layers", "rank"):
        got = skyline_survivors(df, "g", "id", F.col("trust"), F.timestamp_seconds(F.col("t")), {k: F.col(k) for k in "abc"}, policy)
        assert {(x["field"], x["id"], x["layer"]) for x in got.collect()} == {("a", 1, 1), ("b", 1, 1), ("c", 2, 2)}


def test_policies_differ_where_a_trusted_record_is_dominated(spark):
    rows = [(1, 1, 1, 9, 1, 0), (1, 2, 1, 5, 0, 1), (1, 3, 2, 9, 1, 1)]  # 1 dominates 2; 3 is complete
    df = spark.createDataFrame(rows, "g int, id long, trust int, t int, a int, b int")
    of = lambda policy: {x["field"]: x["id"] for x in skyline_survivors(df, "g", "id", F.col("trust"), F.timestamp_seconds(F.col("t")), {k: F.col(k) for k in "ab"}, policy).collect()}
    assert of("layers") == {"a": 1, "b": 3} and of("rank") == {"a": 1, "b": 2}
