"""Workload of vertices and edges, cost of a direction, compression of an order."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import global_rank
from .degree import degrees, out_degrees, running_sums, with_isolated
from .orient import by_degree
from .prepare import vertices

# fixed values: bandwidth and balance by list length 0..9, and the fits beyond
BANDWIDTH = [0.0, 0.0, 271.0, 310.0, 399.0, 419.0, 458.0, 478.0, 524.0, 539.0]
BALANCE = [0.0, 0.0, 145.51, 121.98, 53.26, 23.92, 16.0, 14.0, 12.94, 10.24]
BANDWIDTH_FIT = (384.1, 0.1491)
BALANCE_FIT = 12.0


def bandwidth(n: int) -> float:
    return BANDWIDTH[n] if n < 10 else BANDWIDTH_FIT[0] * n ** BANDWIDTH_FIT[1]


def balance(n: int) -> float:
    return BALANCE[n] if n < 10 else BALANCE_FIT * bandwidth(n) ** 0.5 / n**0.5


def cost_model(lengths: DataFrame, col: str = "deg") -> DataFrame:
    """``lengths`` with bandwidth and balance of a list length."""
    c = F.col(col)
    at = lambda t: F.element_at(F.array(*map(F.lit, t)), (F.least(c, F.lit(9)) + 1).cast("int"))
    with_bw = lengths.withColumn("bandwidth", F.when(c < 10, at(BANDWIDTH)).otherwise(BANDWIDTH_FIT[0] * F.pow(c.cast("double"), F.lit(BANDWIDTH_FIT[1]))))
    return with_bw.withColumn("balance", F.when(c < 10, at(BALANCE)).otherwise(BALANCE_FIT * F.sqrt("bandwidth") / F.sqrt(c.cast("double"))))


def vertex_workload(directed: DataFrame) -> DataFrame:
    """v, work: successors' successors times the rounded-down binary logarithm of the own successors; all ids."""
    d = out_degrees(directed)
    met = directed.join(d, directed["dst"] == d["v"], "left").groupBy("src").agg(F.count("*").alias("own"), F.sum(F.coalesce("out_deg", F.lit(0))).alias("two"))
    work = met.select(F.col("src").alias("v"), (F.col("two") * F.floor(F.log2("own"))).cast("long").alias("work"))
    return with_isolated(work, vertices(directed), "work")


def balanced_blocks(workload: DataFrame, blocks: int) -> DataFrame:
    """v, work, block: contiguous id ranges of about equal work."""
    total = workload.agg(F.sum("work")).first()[0] or 0
    step = max(1, -(-total // blocks))
    cum = F.col("before") + F.col("work")
    return running_sums(workload, "work").select("v", "work", F.greatest(F.lit(0), F.floor((cum - 1) / step)).cast("long").alias("block"))


def edge_workload(directed: DataFrame) -> DataFrame:
    """src, dst, work, longer: the shorter list times the binary logarithm of the longer one plus 2, rounded down."""
    d = out_degrees(directed)
    a = directed.join(d.select(F.col("v").alias("src"), F.col("out_deg").alias("l1")), "src")
    b = a.join(d.select(F.col("v").alias("dst"), F.col("out_deg").alias("l2")), "dst", "left").select("src", "dst", "l1", F.coalesce("l2", F.lit(0)).alias("l2"))
    short, long = F.least("l1", "l2"), F.greatest("l1", "l2")
    return b.select("src", "dst", F.floor(short * F.log2(long + F.lit(2)) + 1e-9).cast("long").alias("work"), long.cast("long").alias("longer"))


def edge_bins(work: DataFrame) -> DataFrame:
    """``work`` with bin 1, 2, 4 .. 32: how many threads an edge's work deserves, by powers of 8."""
    most = work.agg(F.max("work")).first()[0] or 1
    power = log(max(most, 1)) / log(8)
    col = F.lit(1)
    for i in (2, 4, 8, 16, 32):
        bound = int(8 ** ((power - 1) * (i - 1) / 32 + 1))
        col = F.when(F.col("work") >= bound, F.lit(i)).otherwise(col)
    return work.withColumn("bin", col.cast("long"))


def rearranged(binned: DataFrame, bin_no: int, threads: int = 1024, group: int = 32) -> DataFrame:
    """src, dst, slot of a bin's edges: sorted by the longer list, groups of 32 dealt round-robin over blocks of
    threads / bin edges; the rest that fills no block comes last."""
    ranked = global_rank(binned.where(F.col("bin") == bin_no), "longer", "src", "dst")
    size, block = ranked.count(), threads // bin_no
    extra, blocks = size % block, size // block
    per = max(1, block // group)
    i = F.col("rank") - extra
    g, at = F.floor(i / group), i % group
    dealt = ((g % max(blocks, 1)) * per + F.floor(g / max(blocks, 1))) * group + at
    return ranked.select("src", "dst", F.when(F.col("rank") < extra, size - extra + F.col("rank")).otherwise(dealt).cast("long").alias("slot"))


def partition_ranges(n: int, edges: int, memory: int) -> list[tuple[int, int]]:
    """Equal id ranges, as many as let two parts' edges (8 bytes each, and offsets) fit ``memory`` bytes."""
    parts = max(1, -(-2 * (8 * edges + 8 * n) // max(1, memory)))
    width = max(1, -(-n // parts))
    return [(lo, min(n, lo + width)) for lo in range(0, n, width)]


def direction_cost(edges: DataFrame, k: int = 1) -> DataFrame:
    """direction, cost: sum of |out-degree - mean| where the out-degree exceeds the mean by over k means; for edges
    directed by id, by degree and as given."""
    every = vertices(edges)
    n, m = every.count(), edges.count()
    mean = m / max(n, 1)
    ways = {"id": edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), "degree": by_degree(edges), "given": edges}
    out = None
    for name, e in ways.items():
        diff = F.col("out_deg") - F.lit(mean)
        row = with_isolated(out_degrees(e), every, "out_deg").agg(F.lit(name).alias("direction"), F.round(F.coalesce(F.sum(F.when(diff > k * mean, F.abs(diff))), F.lit(0.0)), 4).alias("cost"))
        out = row if out is None else out.unionByName(row)
    return out


def direction_deviation(edges: DataFrame) -> DataFrame:
    """given, by_degree: sums of |mean - out-degree| over all ids."""
    every = vertices(edges)
    mean = edges.count() / max(every.count(), 1)
    total = lambda e, name: with_isolated(out_degrees(e), every, "out_deg").agg(F.round(F.sum(F.abs(F.lit(mean) - F.col("out_deg"))), 4).alias(name))
    return total(edges, "given").crossJoin(F.broadcast(total(by_degree(edges), "by_degree")))  # one row each


def approximation_ratio(edges: DataFrame) -> DataFrame:
    """ratio: bound on how far a degree-based direction lies from the best one, from the degree histogram."""
    every = vertices(edges)
    n, m = every.count(), edges.count()
    a = m / max(n, 1)
    hist = with_isolated(degrees(edges), every, "deg").groupBy("deg").agg(F.count("*").alias("c"))
    d, c = F.col("deg"), F.col("c")
    s = hist.agg(
        F.sum(F.when(d <= a, d * c)).alias("low"), F.sum(F.when(d > a, d * c)).alias("high"), F.sum(F.when(d > a, c)).alias("n_high"),
        F.sum(F.when((d >= 1) & (d <= a), c * (F.lit(a) - d))).alias("lb1"), F.sum(F.when(d > int(a), F.floor(c * d / 2))).alias("rem"),
    ).first()
    low, high, n_high, lb1, rem = (float(s[x] or 0) for x in ("low", "high", "n_high", "lb1", "rem"))
    if n_high and high / n_high / 2 >= a:
        lb2 = max(0.0, (high - low) / 2 - a * n_high)
    else:
        lb2 = a * n_high - high / 2
    # the walk: whole degrees while the rest exceeds their ends, then a part of one
    w = Window.orderBy("deg").rowsBetween(Window.unboundedPreceding, -1)
    walk = hist.where(d > int(a)).select("deg", "c", F.coalesce(F.sum(d * c).over(w), F.lit(0)).alias("before"))  # a row a distinct degree
    left = F.lit(rem) - F.col("before")
    ub = walk.where(left > 0).agg(F.sum(F.when(left > d * c, a * c).otherwise(a * left / d))).first()[0] or 0.0
    ratio = 1 + ub / (lb1 + lb2) if lb1 + lb2 else float("nan")
    return edges.sparkSession.createDataFrame([(round(ratio, 6),)], "ratio double")


def pack_ratio(edges: DataFrame, shift: int = 5) -> DataFrame:
    """Packed words per edge over out-lists, in-lists and their mean; the locality score weighted by the square root
    of list lengths, the plain one, and space in MB."""
    def side(own, other):
        return edges.groupBy(F.col(own).alias("v")).agg(F.count("*").alias("len"), F.count_distinct(F.shiftright(other, shift)).alias("words"))

    n, m = vertices(edges).count(), edges.count()
    o = side("src", "dst").agg(F.sum("words").alias("ow"), F.sum(F.col("words") * F.sqrt("len")).alias("os"), F.sum(F.sqrt("len")).alias("sq"))
    i = side("dst", "src").agg(F.sum("words").alias("iw"), F.sum(F.col("words") * F.sqrt("len")).alias("is"))
    r = o.crossJoin(F.broadcast(i))  # one row each
    mb = 4.0 / 1024 / 1024
    return r.select(
        F.round(F.col("ow") / m, 6).alias("out_ratio"), F.round(F.col("iw") / m, 6).alias("in_ratio"), F.round((F.col("ow") / m + F.col("iw") / m) / 2, 6).alias("ratio"),
        F.round((F.col("os") + F.col("is")) / F.col("sq"), 6).alias("score"), F.round((F.col("ow") + F.col("iw")) / (2.0 * n), 6).alias("norm"),
        F.lit(round((2 * m + 4 * n) * mb, 6)).alias("plain_mb"), F.round((1.5 * (F.col("ow") + F.col("iw")) + 4 * n) * mb, 6).alias("packed_mb"),
    )
