"""Incremental merge of a stream of company rows into a written catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinspark.plans.consolidate import COLUMNS, update


def merge_stream(rows: DataFrame, catalogue_path: str, checkpoint: str, respect_priority: bool = False) -> StreamingQuery:
    """Every micro-batch of ``rows`` (catalogue columns) is merged into the catalogue of the last one.

    Each batch writes a version of its own, ``<path>/v=<batch>``, so a batch that is run
    again after a failure writes the same version anew; ``latest`` reads the newest.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, catalogue_path, number)
        new = batch.select(*COLUMNS)
        merged = new if before is None else before.select(*COLUMNS)
        update(merged, new, respect_priority).write.mode("overwrite").parquet(f"{catalogue_path}/v={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, catalogue_path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the catalogue, of those older than ``before`` if given."""
    path = spark._jvm.org.apache.hadoop.fs.Path(catalogue_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    versions = sorted(int(n[2:]) for n in names if n.startswith("v="))
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{catalogue_path}/v={versions[-1]}") if versions else None
