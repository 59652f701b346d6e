"""Labelled subgraph matching. A pattern all of whose edges have an end beside one of its vertices is searched in the
block of that vertex; any other becomes a chain of joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize, replace, ship_package
from . import blocks

#: two-step paths that a task holds at once
PATHS = 500_000
#: labels of at most so many vertices are sent to all tasks
SENT_LABELS = 2_000_000


@dataclass(frozen=True)
class Pattern:
    """labels[i] is the label of pattern vertex i; edges are pairs of pattern vertices."""

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int], ...]

    def __repr__(self):
        return f"Pattern({len(self.labels)} vertices {list(self.labels)}, edges {list(self.edges)})"

    def neighbours(self, q: int) -> list[int]:
        return sorted({b if a == q else a for a, b in self.edges if q in (a, b) and a != b})

    def connected(self) -> bool:
        return bool(self.labels) and len(join_order(self, {})) == len(self.labels)


def parse_patterns(text: str) -> list[Pattern]:
    """Any number of: vertices, edges, labels, pairs - as numbers between white space."""
    numbers = iter(map(int, text.split()))
    out = []
    for n in numbers:
        m = next(numbers)
        labels = tuple(next(numbers) for _ in range(n))
        pairs = [(next(numbers), next(numbers)) for _ in range(m)]
        out.append(Pattern(labels, tuple((min(p), max(p)) for p in pairs)))
    return out


def join_order(pattern: Pattern, frequency: dict[int, int]) -> list[int]:
    """Depth first from the vertex of the rarest label; neighbours by label frequency, then number."""
    rarity = lambda q: (frequency.get(pattern.labels[q], 0), q)
    order: list[int] = []
    stack = [min(range(len(pattern.labels)), key=rarity)] if pattern.labels else []
    while stack:
        q = stack.pop()
        if q not in order:
            order.append(q)
            stack += sorted((n for n in pattern.neighbours(q) if n not in order), key=rarity, reverse=True)
    return order


def match(edges: DataFrame, labels: DataFrame, pattern: Pattern, frequency: dict[int, int] | None = None) -> DataFrame:
    """q0..qk: every injective embedding along stored edges, automorphic ones each; not induced.

    ``edges`` (src, dst) is followed as stored: symmetrise it for undirected matching. A repeated edge counts once. A pattern that isn't connected
    gives an empty result. An edge of the pattern is followed from the end that comes first in ``join_order``.
    """
    spark, k = edges.sparkSession, len(pattern.labels)
    if not pattern.connected():
        return spark.createDataFrame([], ", ".join(f"q{i} long" for i in range(k)) or "q0 long")
    if frequency is None:
        frequency = {r["label"]: r["n"] for r in labels.where(F.col("label").isin(*set(pattern.labels))).groupBy("label").agg(F.count("*").alias("n")).collect()}  # labels of the pattern
    order = join_order(pattern, frequency)
    of = lambda q, name: labels.where(F.col("label") == pattern.labels[q]).select(F.col("v").cast("long").alias(name))
    root = centre(pattern, order) if k > 2 else None
    if root is not None:
        return _match_around(edges, labels, pattern, order, root)
    clean = edges.where("src <> dst").select("src", "dst").distinct()
    rows, bound = of(order[0], f"q{order[0]}"), [order[0]]
    for q in order[1:]:
        back = [b for b in bound if b in pattern.neighbours(q)]
        name = f"q{q}"
        step = clean.select(F.col("src").alias("__s"), F.col("dst").alias(name)).join(of(q, "__l"), F.col(name) == F.col("__l"), "left_semi")
        rows = rows.join(step, F.col(f"q{back[0]}") == F.col("__s")).drop("__s")
        for b in bound:
            if b != back[0]:  # a stored edge has two ends, so the first neighbour differs by itself
                rows = rows.where(F.col(name) != F.col(f"q{b}"))
        for b in back[1:]:
            check = clean.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
            rows = rows.join(check, (F.col(f"q{b}") == F.col("__s")) & (F.col(name) == F.col("__d")), "left_semi")
        bound.append(q)
    return rows.select(*(f"q{i}" for i in range(k)))


def centre(pattern: Pattern, order: list[int]) -> int | None:
    """The vertex for whose neighbours' lists all edges can be told, with most others beside it; None if there is none."""
    near = {q: set(pattern.neighbours(q)) for q in order}
    able = [r for r in order if all(a == b or r in (a, b) or {a, b} & near[r] for a, b in pattern.edges)]
    return max(able, key=lambda r: (len(near[r]), -order.index(r)), default=None)


def _match_around(edges: DataFrame, labels: DataFrame, pattern: Pattern, order: list[int], root: int) -> DataFrame:
    """``match`` in blocks of the root's ids: a task gets the lists of its roots and of those they lead to, restricted to
    the labels that the pattern asks for. Edges beside the root are tables (root, x, y) there, joined root by root; paths
    and partial matches never leave the task."""
    spark, k, label = edges.sparkSession, len(pattern.labels), pattern.labels
    ship_package(spark)
    beside = pattern.neighbours(root)
    inner = sorted({(min(e, key=lambda q: (q not in beside, q)), max(e, key=lambda q: (q not in beside, q))) for e in pattern.edges if root not in e and e[0] != e[1]})
    # lists that are needed: (of the root, label of the vertex, label of its elements, against the stored direction)
    kind = lambda own, a, b: (own, label[a], label[b], order.index(a) > order.index(b))
    kinds = sorted({kind(True, root, q) for q in beside} | {kind(False, a, b) for a, b in inner})
    known = materialize(labels.where(F.col("label").isin(*set(label))).select(F.col("v").cast("long").alias("v"), F.col("label").cast("long").alias("label")).distinct(), "labels")
    sent = F.broadcast(known) if known.count() <= SENT_LABELS else known
    ends = [sent.select(F.col("v").alias(c), F.col("label").alias(f"__{c}")) for c in ("src", "dst")]
    marked = edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).join(ends[0], "src").join(ends[1], "dst")
    roles = []
    for i, (_, a, b, flip) in enumerate(kinds):
        v, w = ("dst", "src") if flip else ("src", "dst")
        held = F.struct(F.lit(i).alias("kind"), F.col(v).alias("v"), F.col(w).alias("w"))
        roles.append(F.when((F.col(f"__{v}") == a) & (F.col(f"__{w}") == b), held))
    rows = materialize(marked.select(F.explode(F.array_compact(F.array(*roles))).alias("r")).select("r.*"), "rows")
    many = rows.count()
    width = max(1, -(-many // blocks.BLOCK_EDGES), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    grouped = rows.repartitionByRange(width, "v").groupBy("v", "kind").agg(F.sort_array(F.collect_set("w")).alias("nbrs"))
    held = replace(rows, grouped.withColumn("block", F.spark_partition_id()), "lists")
    of_root = [i for i, c in enumerate(kinds) if c[0]]
    own, far = held.where(F.col("kind").isin(*of_root)), held.where(~F.col("kind").isin(*of_root))
    apart = [(a, b) for a in range(k) for b in range(a) if a not in pattern.neighbours(b)]
    names = [f"q{i}" for i in range(k)]

    def run(table):
        import numpy as np

        v, size, flat = table.column("v").to_numpy(), *blocks.Lists.flat(table.column("nbrs"))
        which = table.column("kind").to_numpy()
        x = blocks.Lists.over(blocks.Lists.different(v, flat))
        n = len(x.ids)
        lists = [x.csr(v[which == i], size[which == i], flat[np.repeat(which == i, size)]) for i in range(len(kinds))]
        at = lambda own, a, b: lists[kinds.index(kind(own, a, b))]
        roots = np.unique(np.searchsorted(x.ids, v[np.isin(which, of_root)]))
        for q in beside:
            roots = roots[at(True, root, q)[1][roots] > 0]
        paths = np.zeros(len(roots))
        for a, b in inner:
            i, e = x.joined(roots, at(True, root, a))
            paths += np.bincount(i, at(False, a, b)[1][e], len(roots))
        upto = np.cumsum(np.maximum(paths, 1))
        found, lo = [], 0
        while lo < len(roots):
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PATHS, side="right"))
            hi = max(lo + 1, min(hi, lo + blocks.CELLS // n))
            r = roots[lo:hi]
            near = {q: dict(zip((root, q), x.joined(r, at(True, root, q)))) for q in beside}
            parts = []
            for a, b in inner:
                first, f = x.joined(near[a][a], at(False, a, b))
                part = {root: near[a][root][first], a: near[a][a][first], b: f}
                parts.append(_pick(part, _common(part, near[b], (root, b), n)) if b in near else part)
            parts += [near[q] for q in beside if not any(q in e for e in inner)]
            rows = parts.pop(min(range(len(parts)), key=lambda i: len(parts[i][root])))
            while parts:
                best = max(range(len(parts)), key=lambda i: (len(rows.keys() & parts[i].keys()), -len(parts[i][root])))
                rows = _joined(rows, parts.pop(best), n)
            rows[root] = r[rows[root]]
            for a, b in apart:
                rows = _pick(rows, rows[a] != rows[b])
            if len(rows[root]):
                found.append(tuple(x.ids[rows[q]] for q in range(k)))
            lo = hi
        return blocks.columns(found, " ".join(names))

    schema = ", ".join(f"{c} long" for c in names)
    if not inner:
        return own.withColumn("own", F.lit(True)).groupBy("block").applyInArrow(run, schema)
    return blocks.around(own, far, run, schema, many)


def _pick(rows: dict, keep) -> dict:
    return {q: c[keep] for q, c in rows.items()}


def _common(rows: dict, others: dict, on: tuple[int, int], n: int):
    """Which of ``rows`` have their (root, vertex) among ``others``; roots are few, vertices below ``n``."""
    import numpy as np

    a, b = (t[on[0]] * n + t[on[1]] for t in (rows, others))
    held = np.zeros(max(a.max(initial=0), b.max(initial=0)) + 1, bool)
    held[b] = True
    return held[a]


def _joined(rows: dict, others: dict, n: int) -> dict:
    """All pairs of rows that agree in the columns both have; the first is the root's."""
    import numpy as np

    on = [q for q in rows if q in others]
    if len(on) > 1:
        rows = _pick(rows, _common(rows, others, (on[0], on[1]), n))
        others = _pick(others, _common(others, rows, (on[0], on[1]), n))
    size = len(rows[on[0]])
    key = np.concatenate([rows[on[0]], others[on[0]]]).astype(np.int64)
    for q in on[1:]:
        if key.max(initial=0) >= (1 << 62) // n:
            key = np.unique(key, return_inverse=True)[1]
        key = key * n + np.concatenate([rows[q], others[q]])
    mine, theirs = key[:size], key[size:]
    by = np.argsort(theirs, kind="stable")
    begin = np.searchsorted(theirs[by], mine)
    many = np.searchsorted(theirs[by], mine, side="right") - begin
    left = np.repeat(np.arange(size), many)
    right = by[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(len(left))]
    return {q: c[left] for q, c in rows.items()} | {q: c[right] for q, c in others.items() if q not in rows}


def count_matches(edges: DataFrame, labels: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """query_id, n of each pattern."""
    parts = [match(edges, labels, p).agg(F.lit(i).alias("query_id"), F.count("*").alias("n")) for i, p in enumerate(patterns)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
