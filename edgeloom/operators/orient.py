"""Directing undirected edges by a total order of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .degree import degrees


def by_id(edges: DataFrame) -> DataFrame:
    """From the larger id to the smaller."""
    return edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))


def by_key(edges: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """From the smaller key to the larger; ``keys`` has v and the columns, and the columns order vertices totally."""
    a = keys.select(F.col("v").alias("av"), F.struct(*cols).alias("ka"))
    b = keys.select(F.col("v").alias("bv"), F.struct(*cols).alias("kb"))
    met = edges.join(a, edges["src"] == a["av"]).join(b, F.col("dst") == F.col("bv"))
    first = F.col("ka") < F.col("kb")
    return met.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def by_degree(edges: DataFrame, tie: str = "smaller_id_first", counts: DataFrame | None = None) -> DataFrame:
    """From the lower degree to the higher. ``counts`` (v, deg) replaces the degrees of ``edges``, as with raw ones."""
    if tie not in ("smaller_id_first", "larger_id_first"):
        raise ValueError("tie is smaller_id_first or larger_id_first")
    d = counts if counts is not None else degrees(edges)
    order = F.col("v") if tie == "smaller_id_first" else -F.col("v")
    return by_key(edges, d.select("v", "deg", order.alias("o")), "deg", "o")
