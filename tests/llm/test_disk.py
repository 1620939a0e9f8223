import time

from pyspark.sql import functions as F

from kinspark import session
from kinspark.llm.match import match_sources
from kinspark.session import CLEANUP_KEY, materialize


def shuffles(spark):
    """The ids of the shuffles that have files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def left(spark, before):
    """The shuffles that came since and have files; they are removed in the background."""
    for _ in range(20):
        if not (new := shuffles(spark) - before):
            break
        time.sleep(0.1)
    return new


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, own = shuffles(spark), spark.conf.get(CLEANUP_KEY)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    joined = counted.join(counted.withColumnRenamed("count", "n"), "k")
    written = materialize(joined)
    assert not left(spark, before) and spark.conf.get(CLEANUP_KEY) == own
    assert written.count() == materialize(joined).count() == joined.count() == 7  # made again


def test_matching_keeps_only_the_table_of_its_result(companies, country_aliases, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    names = [("Kelvaro Mitusa Inc", "ASX"), ("Mitusa Kelvaro Inc", "LSE"), ("Kelvaro Mitussa Inc", "TSX")]
    rows = [{"rec_id": i, "name": name, "country": "US", "source": source} for i, (name, source) in enumerate(names)]
    got = match_sources(companies(*rows), country_aliases, generic=["gold"])
    kept = {p.name.partition("-")[0] for p in (tmp_path / "kinspark").iterdir()}
    # besides, tables of the cities and forms of records without a country
    assert "placed" in kept and kept <= {"placed", "homes", "lost"}
    assert got.count() == 3
