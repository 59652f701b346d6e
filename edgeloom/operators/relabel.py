"""Vertex orders by ranks and arithmetic, and their application to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import global_rank
from .degree import degrees, in_out_degrees, out_degrees_all, with_isolated
from .orient import by_id
from .prepare import vertices


def apply(edges: DataFrame, relabel: DataFrame) -> DataFrame:
    """Both ends replaced by their new ids; Spark broadcasts ``relabel`` only below its own size threshold."""
    a = relabel.select(F.col("old_id").alias("__a"), F.col("new_id").alias("__na"))
    b = relabel.select(F.col("old_id").alias("__b"), F.col("new_id").alias("__nb"))
    return edges.join(a, F.col("src") == F.col("__a")).join(b, F.col("dst") == F.col("__b")).select(F.col("__na").alias("src"), F.col("__nb").alias("dst"))


def shuffled_by(col: str, seed: int):
    """A random-looking key of a number, the same on every system."""
    return F.md5(F.concat_ws("-", F.col(col).cast("string"), F.lit(str(seed))))


def _as_map(ranked: DataFrame, new=None) -> DataFrame:
    return ranked.select(F.col("v").alias("old_id"), (F.col("rank") if new is None else new).cast("long").alias("new_id"))


def degree_relabel(edges: DataFrame) -> DataFrame:
    """Rank by falling degree; of equal degrees the larger id comes first, so a hub is 0."""
    d = with_isolated(degrees(edges), vertices(edges), "deg")
    return _as_map(global_rank(d, F.desc("deg"), F.desc("v")))


def degree_relabel_orient(edges: DataFrame) -> DataFrame:
    return by_id(apply(edges, degree_relabel(edges)))


def degree_ascending(edges: DataFrame) -> DataFrame:
    d = in_out_degrees(edges)
    return _as_map(global_rank(d.select("v", (F.col("out_deg") + F.col("in_deg")).alias("deg")), "deg", "v"))


def degree_descending(edges: DataFrame) -> DataFrame:
    d = in_out_degrees(edges)
    return _as_map(global_rank(d.select("v", (F.col("out_deg") + F.col("in_deg")).alias("deg")), F.desc("deg"), "v"))


def out_degree_descending(directed: DataFrame) -> DataFrame:
    """Rank by falling out-degree, larger ids first."""
    return _as_map(global_rank(out_degrees_all(directed), F.desc("out_deg"), F.desc("v")))


def dealt_order(directed: DataFrame, bucket: int = 40) -> DataFrame:
    """The descending list cut into n div bucket long chunks and dealt so that each bucket takes one of every chunk."""
    ranked = global_rank(out_degrees_all(directed), F.desc("out_deg"), F.desc("v"))
    chunk = ranked.count() // bucket
    r = F.col("rank")
    if chunk == 0:
        return _as_map(ranked)
    return _as_map(ranked, F.when(r < bucket * chunk, F.floor(r % chunk) * bucket + F.floor(r / chunk)).otherwise(r))


def snake_order(directed: DataFrame, bucket: int = 64, seed: int | None = None) -> DataFrame:
    """As ``dealt_order``, with every second chunk reversed; with a seed each bucket is shuffled."""
    ranked = global_rank(out_degrees_all(directed), F.desc("out_deg"), F.desc("v"))
    chunk = ranked.count() // bucket
    r = F.col("rank")
    if chunk == 0:
        placed = ranked.withColumn("pos", r)
    else:
        c, i = F.floor(r / chunk), r % chunk
        i = F.when(c % 2 == 1, chunk - 1 - i).otherwise(i)
        placed = ranked.withColumn("pos", F.when(r < bucket * chunk, i * bucket + c).otherwise(r).cast("long"))
    if seed is None:
        return placed.select(F.col("v").alias("old_id"), F.col("pos").alias("new_id"))
    whole = bucket * chunk
    group = F.when(F.col("pos") < whole, F.floor(F.col("pos") / bucket)).otherwise(-1 - F.col("pos"))
    w = Window.partitionBy("g").orderBy(shuffled_by("v", seed), "v")
    shuffled = placed.withColumn("g", group).withColumn("i", F.row_number().over(w) - 1)
    return shuffled.select(F.col("v").alias("old_id"), F.when(F.col("g") >= 0, F.col("g") * bucket + F.col("i")).otherwise(F.col("pos")).cast("long").alias("new_id"))


def random_order(edges: DataFrame, seed: int = 0) -> DataFrame:
    return _as_map(global_rank(vertices(edges).withColumn("h", shuffled_by("v", seed)), "h", "v"))


def compact_ids(edges: DataFrame) -> DataFrame:
    """old_id, new_id: used ids without gaps, in their order."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    return _as_map(global_rank(used, "v"))


def first_seen(edges_at: DataFrame) -> DataFrame:
    """Ids by first appearance as a source (column pos gives the order of rows), the others after them by id."""
    seen = edges_at.groupBy(F.col("src").alias("v")).agg(F.min("pos").alias("pos"))
    every = vertices(edges_at.select("src", "dst")).join(seen, "v", "left")
    return _as_map(global_rank(every.select("v", "pos"), F.col("pos").asc_nulls_last(), "v"))


def alpha(edges: DataFrame) -> DataFrame:
    """v, alpha: the square root of each total degree over the sum of all."""
    d = with_isolated(degrees(edges), vertices(edges), "deg").select("v", F.sqrt("deg").alias("s"))
    total = d.agg(F.sum("s").alias("t"))
    return d.join(F.broadcast(total)).select("v", F.round(F.col("s") / F.col("t"), 9).alias("alpha"))  # one number


def neighbour_order(edges: DataFrame) -> DataFrame:
    """src, dst, place of dst among src's neighbours: higher degree first, then the smaller id."""
    d = degrees(edges)
    w = Window.partitionBy("src").orderBy(F.desc("deg"), "dst")
    met = edges.join(d, edges["dst"] == d["v"])
    return met.select("src", "dst", F.row_number().over(w).cast("long").alias("place"))
