"""Triangle counting over edges directed by degree, by four interchangeable plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from . import blocks
from .degree import degrees
from .orient import by_degree
from .prepare import adjacency, canonical_table, n_of

PLANS = ("semi", "array", "bsr", "partitioned")
#: two-step ends that a task looks up at once
WEDGES = 4_000_000


def directed(edges: DataFrame) -> DataFrame:
    """Canonical edges from the lower degree to the higher: no vertex has more than about sqrt(2 E) successors."""
    simple = canonical_table(edges)
    return by_degree(simple, counts=materialize(degrees(simple), "degrees"))


def wedges(o: DataFrame) -> DataFrame:
    """u, v, w with u to v, and u to w, v before w as ids: each pair of successors once."""
    a = adjacency(o).select(F.col("v").alias("u"), "nbrs")
    pairs = a.where(F.size("nbrs") > 1).select("u", "nbrs", F.posexplode("nbrs").alias("i", "v"))
    return pairs.select("u", "v", F.explode(F.slice("nbrs", F.col("i") + 2, F.greatest(F.size("nbrs"), F.lit(1)))).alias("w"))


def triangles(o: DataFrame) -> DataFrame:
    """a, b, c of each triangle: u to v, v to w, u to w. Paths are closed in the task of u's block, by its own list."""

    def run(table):
        import numpy as np

        x, out = blocks.Lists(table), []
        for u, near, i, j in x.links():
            out.append((np.full(len(i), x.ids[u]), x.ids[near[i]], x.ids[near[j]]))
        return blocks.columns(out, "a b c")

    own = blocks.lists(o)
    return blocks.around(own, own, run, "a long, b long, c long")


def closed_wedges(o: DataFrame) -> DataFrame:
    """triangles: how many two-step paths from a block's vertices end in their own lists (a left-semi join with
    them, in one task), a row a block."""

    def run(table):
        import pyarrow as pa

        return pa.table({"triangles": pa.array([sum(len(i) for _, _, i, _ in blocks.Lists(table).links())], pa.int64())})

    own = blocks.lists(o)
    return blocks.around(own, own, run, "triangles long")


def support(o: DataFrame) -> DataFrame:
    """src, dst, support: common successors of the ends of each directed edge; edges without any are left out."""
    adj = adjacency(o).select("v", "nbrs")
    left = o.join(adj.select(F.col("v").alias("src"), F.col("nbrs").alias("n1")), "src")
    both = left.join(adj.select(F.col("v").alias("dst"), F.col("nbrs").alias("n2")), "dst")
    return both.select("src", "dst", F.size(F.array_intersect("n1", "n2")).cast("long").alias("support")).where("support > 0")


def packed_support(o: DataFrame) -> DataFrame:
    """The same by bit-packed successors: states with equal bases meet, their common bits are counted, in the task of
    the block of src."""

    def run(table):
        import numpy as np

        x, out = blocks.Lists(table), []
        base, state = x.pack(x.own), x.pack(x.far)
        mine = np.zeros(len(x.ids) // 32 + 1, np.uint32)
        for u in x.starts.tolist():
            near = x.of(u)
            at = slice(base[0][u], base[0][u] + base[1][u])
            mine[base[2][at]] = base[3][at]
            first, words, bits = x.packed(near, state)
            n = np.bincount(first, np.bitwise_count(mine[words] & bits), len(near)).astype(np.int64)
            mine[base[2][at]] = 0
            out.append((np.full(int((n > 0).sum()), x.ids[u]), x.ids[near[n > 0]], n[n > 0]))
        return blocks.columns(out, "src dst support")

    own = blocks.lists(o)
    return blocks.around(own, own, run, "src long, dst long, support long")


def partial_counts(o: DataFrame, n: int, parts: int) -> DataFrame:
    """m, k, triangles: triangles by the id ranges of the first and the second vertex of each directed edge.

    Ranges are cut into blocks, a task each: it gets the edges that start in the block and the successors of the
    vertices they lead to, and looks each edge's two-step ends up in a sorted list of the block's edges. A block that a
    list isn't needed in doesn't get it, so pairs of ranges without edges between them cost nothing.
    """
    width = max(1, -(-n // parts))

    def count(table):
        import numpy as np
        import pyarrow as pa

        x = blocks.Lists(table)
        begin, size, flat = x.own
        u = np.repeat(x.starts, size[x.starts])
        v = np.concatenate([flat[:0], *(x.of(s) for s in x.starts.tolist())])
        n_ids = len(x.ids)
        known = np.sort(u * n_ids + v)
        found, upto = np.zeros(len(u), np.int64), np.cumsum(x.far[1][v])
        lo = 0
        while lo < len(u):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WEDGES, side="right")))
            first, ends = x.joined(v[lo:hi])
            ends = u[lo:hi][first] * n_ids + ends
            place = np.minimum(np.searchsorted(known, ends), len(known) - 1)
            found[lo:hi] = np.bincount(first[known[place] == ends], minlength=hi - lo)
            lo = hi
        pairs = pa.table({"m": x.ids[u] // width, "k": x.ids[v] // width, "triangles": found}).group_by(["m", "k"]).aggregate([("triangles", "sum")])
        return pairs.select(["m", "k", "triangles_sum"]).rename_columns(["m", "k", "triangles"])

    own = blocks.lists(o)
    found = blocks.around(own, own, count, "m long, k long, triangles long")
    return found.groupBy("m", "k").agg(F.sum("triangles").alias("triangles")).where("triangles > 0")


def count_triangles(o: DataFrame, plan: str = "semi", parts: int = 4, n: int | None = None) -> DataFrame:
    """One row: triangles. All plans count the same. The directed graph is written once, since each plan reads it more
    than once."""
    if plan not in PLANS:
        raise ValueError(f"plan is one of {PLANS}")
    o = materialize(o, "directed")
    if plan == "semi":
        return closed_wedges(o).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))
    if plan == "array":
        return support(o).agg(F.coalesce(F.sum("support"), F.lit(0)).alias("triangles"))
    if plan == "bsr":
        return packed_support(o).agg(F.coalesce(F.sum("support"), F.lit(0)).alias("triangles"))
    return partial_counts(o, n_of(o) if n is None else n, parts).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))
