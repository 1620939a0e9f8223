import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from kinspark.llm.oracles import ORACLES  # noqa: E402
from compare import rows  # noqa: E402


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, db, name):
    assert rows(entry.queries()[name](spark, sf).toArrow()) == rows(db.execute(ORACLES[name]).to_arrow_table())


COLUMNS = {
    "p3_found": [("rec_id_a", "bigint"), ("rec_id_b", "bigint")], "p4_found": [("rec_id_a", "bigint"), ("rec_id_b", "bigint")], "p5_found": [("rec_id_a", "bigint"), ("rec_id_b", "bigint")],
    "p6_found": [("rec_id", "bigint"), ("field", "string")], "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p8_containers": [("pack_name", "string"), ("doc_id", "bigint"), ("piece", "bigint"), ("tokens", "bigint"), ("container", "bigint")],
    "p9_found": [("doc_id", "bigint")], "p1_found": [("group_id", "bigint"), ("field", "string"), ("rec_id", "bigint")], "p2_found": [("rec_id", "bigint"), ("group_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.dtypes == COLUMNS[name]
    got = df.drop("ids").collect()
    assert got and len(got) == len(set(got))
    if "rec_id_a" in df.columns:
        assert all(r["rec_id_a"] < r["rec_id_b"] for r in got)
