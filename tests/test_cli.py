from kinspark import cli
from kinspark.functions.register import register_all
from kinspark.sources import samples


def test_jobs(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    samples.registry(spark).write.parquet(at("registry"))
    samples.knowledge(spark).write.parquet(at("knowledge"))
    samples.listings(spark).write.parquet(at("listings"))
    assert cli.main(["build", at("cat"), "--registry", at("registry"), "--knowledge", at("knowledge")]) == 0
    assert spark.read.parquet(at("cat")).count() == 3
    assert cli.main(["expand", at("cat"), at("listings"), at("cat2")]) == 0
    assert spark.read.parquet(at("cat2")).count() == 13
    assert cli.main(["update", at("cat"), at("cat2"), at("cat3")]) == 0
    assert spark.read.parquet(at("cat3")).count() == 13
    assert cli.main(["link", at("listings"), at("registry"), at("links")]) == 0
    assert cli.main(["profile", at("cat2")]) == 0
    out = capsys.readouterr().out
    assert "source: ASX" in out and "Links" in out
    (tmp_path / "m.yaml").write_text("metals:\n  - {name: Tin, symbol: Sn, category_bucket: base, cluster_id: c, default_unit: t, default_basis: $/t}\n")
    (tmp_path / "c.yaml").write_text("clusters:\n  c: {name: C, sources: [X]}\n")
    assert cli.main(["metals", at("m.yaml"), at("c.yaml"), at("metals")]) == 0
    (tmp_path / "d.yaml").write_text("clusters:\n  d: {name: D}\n")
    assert cli.main(["metals", at("m.yaml"), at("d.yaml"), at("metals")]) == 1
    spark.createDataFrame([(1, "lithium carbonate")], "doc_id long, text string").write.parquet(at("docs"))
    assert cli.main(["extract", at("docs"), at("mentions")]) == 0
    assert spark.read.parquet(at("mentions")).first()["query"] == "lithium carbonate"


def test_sql_functions(spark):
    register_all(spark)
    row = spark.sql("SELECT weighted_ratio('this is a test', 'this is a new test') AS s").first()
    assert row["s"] == 95.0
    rows = spark.sql("SELECT d.i, m.query FROM VALUES (1, 'gold and (Au)') AS d(i, t), LATERAL extract_metals(d.t) m ORDER BY m.start").collect()
    assert [(r["i"], r["query"]) for r in rows] == [(1, "gold"), (1, "au")]
