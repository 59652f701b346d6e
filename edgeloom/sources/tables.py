"""Edge, label and set views over the part-supplier tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def partsupp_raw(spark, sf_dir) -> DataFrame:
    """Part to supplier in one id space: loops and duplicates included."""
    return _lineitem(spark, sf_dir).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def copart_raw(spark, sf_dir) -> DataFrame:
    """Pairs of parts in one order."""
    rows = _lineitem(spark, sf_dir).select("l_orderkey", "l_partkey")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") < F.col("b.l_partkey")))
    return met.select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"))


def part_labels(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("v"), (F.col("p_size") % 3).cast("int").alias("label"))


def supplier_sets(spark, sf_dir) -> DataFrame:
    return _lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("elem")).distinct()
