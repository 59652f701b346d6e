"""Edge preparation: cleaning, order of ends, adjacency, bit-packed adjacency, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize


def vertex_count(edges: DataFrame) -> DataFrame:
    """n: the largest id plus one (0 for no edges)."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).cast("long").alias("n"))


def n_of(edges: DataFrame) -> int:
    return vertex_count(edges).first()["n"]


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, its smaller end first, without loops. A table that is known to be so stays."""
    if getattr(edges, "_edgeloom_canonical", False):
        return edges
    return drop_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def canonical_table(edges: DataFrame) -> DataFrame:
    """``canonical_edges`` as a table, made once however often it is read: in the order of its ends, which takes a third
    of the room. One range exchange serves the order and the comparison."""
    if getattr(edges, "_edgeloom_canonical", False):
        return edges
    ends = drop_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    table = materialize(ends.repartitionByRange("src", "dst").distinct().sortWithinPartitions("src", "dst"), "canonical")
    table._edgeloom_canonical = True
    return table


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def both_directions(edges: DataFrame) -> DataFrame:
    """Both directions of each row, repeated edges as often: nothing is compared, so no shuffle, and ``edges`` is read once."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("e")).select("e.src", "e.dst")


def upper(edges: DataFrame) -> DataFrame:
    return edges.where("src < dst")


def lower(edges: DataFrame) -> DataFrame:
    return edges.where("src > dst")


def split_by(edges: DataFrame, predicate) -> tuple[DataFrame, DataFrame]:
    return edges.where(predicate), edges.where(~predicate)


#: ids that ``vertices`` makes at most
MOST_IDS = 1 << 40


def vertices(edges: DataFrame) -> DataFrame:
    """v: every id from 0 to the largest, isolated ones too. Ids beyond ``MOST_IDS`` are refused: compact them first."""
    n = n_of(edges)
    if n > MOST_IDS:
        raise ValueError(f"ids reach {n}; give them new ones by compact_ids first")
    return edges.sparkSession.range(n).select(F.col("id").alias("v"))


def adjacency(edges: DataFrame) -> DataFrame:
    """v, nbrs (ascending), deg of each vertex with outgoing edges."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs")).withColumn("deg", F.size("nbrs").cast("long"))


def adjacency_edges(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("v").alias("src"), F.explode("nbrs").alias("dst"))


def nonempty(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).distinct()


def sort_edges(edges: DataFrame, partitions: int) -> DataFrame:
    """Range-partitioned by source and sorted in each partition: a global order without a single task."""
    return edges.repartitionByRange(partitions, "src", "dst").sortWithinPartitions("src", "dst")


def pack(edges: DataFrame, set_col: str = "src", elem_col: str = "dst") -> DataFrame:
    """set_id, base (element div 32), state (bits of element mod 32). States are long: a set sign bit of an int would
    count as more than one bit."""
    bits = edges.select(F.col(set_col).alias("set_id"), F.shiftright(elem_col, 5).alias("base"), F.expr(f"shiftleft(1L, cast({elem_col} & 31 as int))").alias("bit"))
    return bits.groupBy("set_id", "base").agg(F.bit_or("bit").alias("state"))


def unpack(packed: DataFrame) -> DataFrame:
    """set_id, elem of packed sets."""
    bits = packed.select("set_id", "base", F.expr("filter(sequence(0, 31), i -> (shiftright(state, i) & 1) = 1)").alias("at"))
    return bits.select("set_id", F.explode("at").alias("i"), "base").select("set_id", (F.col("base") * 32 + F.col("i")).cast("long").alias("elem"))


def in_out_index(edges: DataFrame) -> DataFrame:
    """v, outs, ins: neighbour lists by direction, joined as text for display (empty where there is none)."""
    o = edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("outs"))
    i = edges.groupBy(F.col("dst").alias("v")).agg(F.sort_array(F.collect_list("src")).alias("ins"))
    none = F.array().cast("array<long>")
    return o.join(i, "v", "full").select("v", F.coalesce("outs", none).alias("outs"), F.coalesce("ins", none).alias("ins"))


def prune_low_degree(edges: DataFrame, degrees: DataFrame, least: int = 2) -> DataFrame:
    """Edges both of whose ends have ``least`` neighbours, by the given degrees (one round)."""
    keep = degrees.where(F.col("deg") >= least).select("v")
    return edges.join(keep, edges["src"] == keep["v"], "left_semi").join(keep, edges["dst"] == keep["v"], "left_semi")


def label_index(labels: DataFrame) -> DataFrame:
    """label, n, members (ascending)."""
    return labels.groupBy("label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("members"))
