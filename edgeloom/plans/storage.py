"""Cutting lineage: tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark deletes an execution's shuffle files at its end, not when the driver happens to collect its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session has none, a local session gets a folder of its own, as in tests; a
    cluster gets an error, since nothing local is shared there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="edgeloom-ckpt-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python finds it."""
    sc = spark.sparkContext
    if getattr(sc, "_edgeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp(prefix='edgeloom-')}/edgeloom_pkg.zip"  # on the driver only; Spark serves the file
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(archive)
    sc._edgeloom_shipped = True


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/edgeloom-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder. The shuffle files behind it go as soon as it is written."""
    path = fresh_path(df.sparkSession, tag)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._edgeloom_path = path
    return back


def replace(old: DataFrame, df: DataFrame, tag: str = "step") -> DataFrame:
    """``materialize``, then delete the materialized table that ``df`` came from and nothing needs any more."""
    new = materialize(df, tag)
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(old._edgeloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return new


def global_rank(df: DataFrame, *keys, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based position in the order of ``keys``.

    A range exchange and a sort in each partition; the positions of partitions come from one count a partition, so
    no task sees all rows. Keys must order the rows totally.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = df.repartitionByRange(width, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    part = F.shiftright("__at", 33)
    offset, rows = 0, []
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a partition
        rows.append((r["p"], offset))
        offset += r["count"]
    if not rows:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__at")
    starts = F.broadcast(spark.createDataFrame(rows, "__p long, __start long"))  # one row a partition
    met = placed.join(starts, part == F.col("__p"))
    return met.withColumn(name, (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__at", "__p", "__start")
