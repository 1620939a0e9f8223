import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import rows  # noqa: E402


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "asked", "best", "score", "gap", "decision"] and df.count() == 12


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(importlib.import_module("kinspark.plans.registry").ORACLES))
def test_core_query_equals_its_sql(spark, sf, db, name):
    assert rows(entry.queries()[name](spark, sf).toArrow()) == rows(db.execute(entry.oracle_sql()[name]).to_arrow_table())


@pytest.mark.parametrize("name", ["link_exact", "document_metals", "consolidate_sources", "classify_cached", "seeded_preview", "country_names"])
def test_core_query_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_the_core_stands_alone():
    code = "import sys; sys.modules['kinspark.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q[0] == 'p' and q[1].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_names_of_the_tables_are_resolved(spark, sf, db):
    asked = {r[0] for r in db.execute("SELECT DISTINCT name FROM exchange_listings WHERE name IS NOT NULL").fetchall()}
    got = entry.queries()["resolve_listings"](spark, sf).collect()
    assert len(got) == len(asked) and {r["asked"] for r in got} == asked
    assert sum(r["score"] >= 90 for r in got) > 0.9 * len(got)


def test_all_metals_are_resolved(spark, sf):
    from kinspark.sources.inventory import METALS

    assert len(METALS) == 50
    got = {r["asked"]: r["name"] for r in entry.queries()["resolve_metals"](spark, sf).collect()}
    assert all(got[m[0]] == m[0] for m in METALS)


@pytest.mark.parametrize("name", ["resolve_companies", "resolve_listings"])
def test_plans_of_resolution_are_small(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
