"""Degrees and aggregates of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import global_rank, materialize
from .prepare import vertices


def degrees(edges: DataFrame) -> DataFrame:
    """v, deg: both ends counted; on raw edges a loop counts twice and duplicates count."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    return ends.groupBy("v").agg(F.count("*").alias("deg"))


def with_isolated(counts: DataFrame, all_vertices: DataFrame, *cols: str) -> DataFrame:
    """Zero for ids that have no row."""
    return all_vertices.join(counts, "v", "left").select("v", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out_deg"))


def out_degrees_all(edges: DataFrame) -> DataFrame:
    return with_isolated(out_degrees(edges), vertices(edges), "out_deg")


def in_out_degrees(edges: DataFrame) -> DataFrame:
    """v, out_deg, in_deg of every id; one aggregation over tagged ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("v").agg(F.sum("o").alias("out_deg"), F.sum(1 - F.col("o")).alias("in_deg"))
    return with_isolated(counts, vertices(edges), "out_deg", "in_deg")


def max_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.max("deg").alias("max_deg"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """deg, n over all ids, isolated ones too."""
    return with_isolated(degrees(edges), vertices(edges), "deg").groupBy("deg").agg(F.count("*").alias("n"))


def running_sums(df: DataFrame, col: str) -> DataFrame:
    """``df`` (with ids in v) with ``before``: the sum of ``col`` over all smaller ids.

    Rows are range-partitioned and sorted by id in a table; each partition's own sums start from what the partitions
    before it hold, one number a partition. No task sees the rows of another.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = df.repartitionByRange(width, "v").sortWithinPartitions("v").withColumn("__p", F.spark_partition_id())
    placed = materialize(placed, "sums")
    total, rows = 0, []
    for r in placed.groupBy("__p").agg(F.sum(col).alias("t")).orderBy("__p").collect():  # one row a partition
        rows.append((r["__p"], total))
        total += r["t"]
    starts = F.broadcast(spark.createDataFrame(rows, "__p int, __start long"))
    inside = Window.partitionBy("__p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(starts, "__p")
    return met.withColumn("before", F.col("__start") + F.coalesce(F.sum(col).over(inside), F.lit(0))).drop("__p", "__start")


def csr_offsets(edges: DataFrame) -> DataFrame:
    """v, deg, start: the exclusive running sum of out-degrees in id order."""
    return running_sums(out_degrees_all(edges), "out_deg").select("v", F.col("out_deg").alias("deg"), F.col("before").alias("start"))


def leaf_ratio(edges: DataFrame) -> DataFrame:
    """Share of ids with one outgoing or one incoming edge."""
    d = in_out_degrees(edges)
    leaf = F.when((F.col("out_deg") == 1) | (F.col("in_deg") == 1), 1).otherwise(0)
    return d.agg(F.sum(leaf).alias("leaves"), F.count("*").alias("n"), F.round(F.sum(leaf) / F.count("*"), 6).alias("ratio"))


def big_vertices(edges: DataFrame, ratio: float) -> DataFrame:
    """v, deg of the highest degrees (ties: smaller id) until their sum reaches ratio * 2 * edges.

    A degree histogram's running sum finds the cutting degree; only its own vertices are ranked.
    """
    d = with_isolated(degrees(edges), vertices(edges), "deg")
    total = edges.count()
    target = int(total * ratio * 2)
    hist = d.groupBy("deg").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum(F.col("deg") * F.col("n")).over(Window.orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = hist.select("deg", "n", above.alias("above")).where(F.col("above") < max(target, 1)).orderBy("deg").limit(1).first()  # a row a distinct degree
    if cut is None:
        return d.limit(0)
    need = 1 if cut["deg"] == 0 else -(-(max(target, 1) - cut["above"]) // cut["deg"])
    edge_of = global_rank(d.where(F.col("deg") == cut["deg"]), "v").where(F.col("rank") < need).select("v", "deg")
    return d.where(F.col("deg") > cut["deg"]).unionByName(edge_of)


def big_vertex_report(edges: DataFrame, ratio: float) -> DataFrame:
    b = big_vertices(edges, ratio)
    return b.agg(F.count("*").alias("n"), F.round(F.avg("deg"), 6).alias("mean_deg"), F.round(F.var_pop("deg"), 6).alias("var_deg"), F.max("deg").alias("max_deg"), F.min("deg").alias("min_deg"))


def label_frequency(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))
