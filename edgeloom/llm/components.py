"""Connected components of an edge table: alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, discard, hot_from, materialize


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Large star: each node ties its larger neighbours to the least of all. Small star: its smaller ones and itself.

    ``rows``: how many edges there are, for a bound on hubs."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    total = 2 * rows
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    if total < HOT_ROWS:
        tied = both.join(least, "a")
    else:  # edges of hubs stay where they are; hubs are few by their size
        hubs = least.where(F.col("n") >= hot_from(total))
        rest = both.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("n") < hot_from(total)), "a")
        tied = both.join(F.broadcast(hubs), "a").unionByName(rest)
    if large:
        return tied.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
    # small star: here a > b on every row
    return tied.where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(tied.select(F.col("a").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: for every node of ``edges`` (u, v: long) the least node it reaches.

    Each round is written to the shared folder; the count and a sum of hashes tell when nothing moves any more.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        large = materialize(_star(now, True, mark[0]), "stars")
        discard(now)
        now = materialize(_star(large, False, mark[0]), "edges")
        discard(large)
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
