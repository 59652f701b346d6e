"""Searches around vertices without shuffling two-step paths: each block of neighbouring ids is one task, which gets
the lists of its own vertices and those of the vertices they lead to, each list once. So what is sent is a list for
each block that reaches it, not one for each edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize, ship_package

#: edges that start in a block, about: blocks are ranges of ids with as many edges
BLOCK_EDGES = 1_000_000
#: cells of a table of candidates that a task holds at once
CELLS = 16_000_000
#: list entries that are sorted or looked up at a time
PIECE = 1 << 20
#: list entries that are sent to blocks in a round at least
SENT = 150_000_000


def lists(o: DataFrame, also: DataFrame | None = None, per: int = BLOCK_EDGES, least: int | None = None) -> DataFrame:
    """block, v, nbrs (ascending) and others: successors of each vertex, and those in ``also``, a second edge list.
    A table, by ranges of ids that hold ``per`` edges each, or fewer: ``least`` ranges
    (as many as a shuffle has partitions) are made at any rate."""
    ship_package(o.sparkSession)
    o = o if hasattr(o, "_edgeloom_path") else materialize(o, "directed")
    rows = o.select("src", "dst", F.lit(True).alias("first"))
    if also is not None:
        rows = materialize(rows.unionByName(also.select("src", "dst", F.lit(False).alias("first"))), "rows")
    least = least or int(o.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    width = max(1, -(-rows.count() // per), least)
    one = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("dst"))))
    both = [one(F.col("first")).alias("nbrs"), one(~F.col("first")).alias("others")] if also is not None else [F.sort_array(F.collect_list("dst")).alias("nbrs")]
    held = rows.repartitionByRange(width, "src").groupBy(F.col("src").alias("v")).agg(*both)
    return materialize(held.withColumn("block", F.spark_partition_id()), "lists")


def around(own: DataFrame, far: DataFrame, run, schema: str, held: int = 0) -> DataFrame:
    """``run`` (lists of a block, schema's columns) over all blocks of ``own`` (from ``lists``). Its table has v, nbrs,
    others where ``own`` has them, and own: false for the rows of ``far`` (v, nbrs, more) that the block's nbrs lead to.

    ``held``: entries of ``far``'s lists. Where it is given and blocks reach so much that over ``SENT`` entries (and
    over twice ``held``) would be sent, they are sent in rounds of blocks, each written before the next."""
    need = own.select("block", F.explode("nbrs").alias("v")).distinct()

    def one(table):
        return run(table.select([c for c in table.column_names if c != "block"]))

    def found(own, need):
        theirs = far.drop("block").join(need, "v").withColumn("own", F.lit(False))
        rows = own.withColumn("own", F.lit(True)).unionByName(theirs, allowMissingColumns=True)
        return rows.groupBy("block").applyInArrow(one, schema)

    return _in_rounds(own, far, need, found, held)


def among(own: DataFrame, values: DataFrame, run, schema: str, held: int) -> DataFrame:
    """Like ``around``, with ``values`` (v, value) of all that a block has, and each list once in it: those of its own
    vertices, and of all that they lead to, whose lists are in ``own`` too. ``run`` gets v, nbrs, own and value."""
    need = own.select("block", F.explode(F.concat("nbrs", F.array("v"))).alias("v")).distinct()
    need = materialize(need.join(values.select("v", "value"), "v"), "need")

    def one(table):
        return run(table.select([c for c in table.column_names if c != "block"]))

    def found(_, need):
        lists = own.select("v", "nbrs", F.col("block").alias("home")).join(need, "v")
        return lists.select("block", "v", "nbrs", (F.col("home") == F.col("block")).alias("own"), "value").groupBy("block").applyInArrow(one, schema)

    return _in_rounds(own, own, need, found, held, 1)


def _in_rounds(own: DataFrame, far: DataFrame, need: DataFrame, found, held: int, times: int = 2) -> DataFrame:
    """``found`` (own, need), in rounds of blocks where more than ``SENT`` and ``times`` ``held`` list entries would go out."""
    most = max(SENT, times * held)
    if not held or held * own.select("block").distinct().count() <= most:
        return found(own, need)
    need = need if hasattr(need, "_edgeloom_path") else materialize(need, "need")
    sizes = far.groupBy("v").agg(F.sum(F.size("nbrs")).alias("n"))
    firsts, total = [0], 0
    for r in need.join(sizes, "v").groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect():  # one row a block
        if total and total + r["n"] > most:
            firsts.append(r["block"])
            total = 0
        total += r["n"]
    parts = []
    for lo, hi in zip(firsts, [*firsts[1:], None]):
        mine = (F.col("block") >= lo) & (F.col("block") < hi if hi is not None else F.lit(True))
        parts.append(found(own.where(mine), need.where(mine)))
    if len(parts) == 1:
        return parts[0]
    out = materialize(parts[0], "found")
    for p in parts[1:]:
        out = out.unionByName(materialize(p, "found"))
    return out


class Lists:
    """A block's lists on places in ``ids``, the sorted ids that it has met: of own vertices and of those they lead to."""

    def __init__(self, table):
        import numpy as np

        own = table.column("own").to_numpy()
        v, size, flat = table.column("v").to_numpy(), *self.flat(table.column("nbrs"))
        more = self.flat(table.column("others")) if "others" in table.column_names else None
        self.ids = np.unique(np.concatenate([v, flat, *([more[1]] if more else [])]))
        self.starts = np.searchsorted(self.ids, v[own])
        self.starts = self.starts.astype(np.int64)
        self.own = self.csr(v[own], size[own], flat[np.repeat(own, size)])
        self.far = self.csr(v[~own], size[~own], flat[np.repeat(~own, size)])
        self.others = self.csr(v[own], more[0][own], more[1][np.repeat(own, more[0])]) if more else None

    @classmethod
    def over(cls, ids):
        """Without lists of its own yet: ``csr`` makes them on places in ``ids``."""
        self = cls.__new__(cls)
        self.ids = ids
        return self

    @staticmethod
    def different(v, flat):
        """All ids, ascending, without another copy of the lists."""
        import numpy as np

        parts = [np.unique(flat[lo : lo + PIECE]) for lo in range(0, len(flat), PIECE)]
        return np.unique(np.concatenate([v, *parts]))

    @staticmethod
    def flat(column):
        import numpy as np

        column = column.combine_chunks()
        if hasattr(column, "chunks"):
            column = column.chunk(0)
        import pyarrow.compute as pc

        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)

    def csr(self, v, size, flat):
        """begin, size of each id's list, and the lists' places one after the other."""
        import numpy as np

        begin, many = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        at = np.searchsorted(self.ids, v)
        begin[at], many[at] = np.cumsum(size) - size, size
        places = np.empty(len(flat), np.int32)
        for lo in range(0, len(flat), PIECE):
            places[lo : lo + PIECE] = np.searchsorted(self.ids, flat[lo : lo + PIECE])
        return begin, many, places

    def of(self, u, which=None):
        begin, size, flat = which or self.own
        return flat[begin[u] : begin[u] + size[u]]

    def joined(self, vs, which=None):
        """(place in ``vs``, element) of all lists of ``vs``."""
        import numpy as np

        begin, size, flat = which or self.far
        many = size[vs]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(np.arange(len(vs)), many), flat[np.repeat(begin[vs] - ends + many, many) + np.arange(total)]

    def pack(self, which):
        """begin, size, base and bits of 32 places each of the lists."""
        import numpy as np

        begin, size, flat = which
        owner = np.flatnonzero(size)
        owner = owner[np.argsort(begin[owner])]
        of = np.repeat(owner, size[owner])
        words = flat >> 5
        new = np.ones(len(flat), bool)
        new[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        bits = np.bitwise_or.reduceat(np.uint32(1) << (flat & 31).astype(np.uint32), at) if len(at) else np.zeros(0, np.uint32)
        many = np.bincount(of[at], minlength=len(size))
        first = np.zeros(len(size), np.int64)
        first[owner] = np.cumsum(many[owner]) - many[owner]
        return first, many, words[at], bits

    def packed(self, vs, packed):
        """(place in ``vs``, base, bits) of all packed lists of ``vs``."""
        import numpy as np

        first, words = self.joined(vs, packed[:3])
        begin, many = packed[0][vs], packed[1][vs]
        return first, words, packed[3][np.repeat(begin - np.cumsum(many) + many, many) + np.arange(len(words))]

    def links(self):
        """(u, its list, pairs of places in that list) of each own vertex: the pairs that ``far`` links."""
        import numpy as np

        place = np.full(len(self.ids), -1, np.int32)
        for u in self.starts.tolist():
            near = self.of(u)
            place[near] = np.arange(len(near), dtype=np.int32)
            first, ends = self.joined(near)
            second = place[ends]
            hit = second >= 0
            place[near] = -1
            yield u, near, first[hit], second[hit]


def columns(parts: list, names: str):
    """A table of long columns from tuples of arrays."""
    import numpy as np
    import pyarrow as pa

    names = names.split()
    if not parts:
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    return pa.table({c: np.concatenate([p[i] for p in parts]).astype(np.int64) for i, c in enumerate(names)})
