"""Session creation, table reading and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a table up to which it is broadcast.
MAX_BROADCAST_BYTES = 8 << 20


def get_session(cores: int | str = "*", app: str = "kinspark", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KINSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster, once an application; a local master shares the driver's path."""
    context = spark.sparkContext
    if context.master.startswith("local") or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kinspark-")) / "kinspark.zip"  # of the driver, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory of ``<name>.parquet`` files or folders."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    The session's own setting is used; only where it is unset (tests, a local
    master) is a temporary folder made and remembered in the session.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        path = "file://" + tempfile.mkdtemp(prefix="kinspark-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within leave no shuffle files behind; else these stay until the driver happens to collect its garbage.

    The session's setting is restored at the end. A query run again later makes its files again.
    """
    own = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, own)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: iterative plans stay short, and a lost executor costs a
    read of the written table instead of a replay of all rounds. The shuffle files of
    its making are removed, as nothing reads them any more.
    """
    path = f"{shared_dir(df.sparkSession)}/kinspark/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("parquet.enable.dictionary", "false").parquet(path)  # mostly hashes, which have no dictionary
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinspark_path = path
    return out


def hash_small_partitions(spark: SparkSession, size: str = "64MB") -> None:
    """Lets adaptive execution hash a side of a join instead of sorting both, where each of its partitions is at most ``size``.

    Partitions beyond that are sorted, and may spill. A session's own setting is kept.
    """
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(key, "0b") in ("0", "0b"):
        spark.conf.set(key, size)


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df``, a written flat table, marked for broadcast if its values take at most ``limit`` bytes; beyond, joins shuffle it."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(0) for c, t in df.dtypes), F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= limit else df


def release(df: DataFrame) -> None:
    """Delete the table that ``materialize`` wrote, once nothing reads it."""
    path = getattr(df, "_kinspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
