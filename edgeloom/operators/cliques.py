"""k-cliques and maximal cliques."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import global_rank, materialize
from . import blocks
from .prepare import adjacency, both_directions, canonical_table, n_of

#: neighbours a vertex may have later in its order before its search is refused: it runs in one task
MOST_LATER = 20_000
#: edge ends in a block of the maximal cliques
CLIQUE_ENDS = 3_000_000
#: pairs of candidates that are looked at together; a vertex whose table of links has over four times as many cells is
#: searched by itself
PAIRS = 1 << 19


def k_cliques(o: DataFrame, k: int) -> DataFrame:
    """v1..vk of each clique of a directed acyclic graph, searched in the task of v1's block among its successors: each
    level carries those common to all so far, as rows of a table of links."""
    if k < 2:
        raise ValueError("k is 2 or more")
    names = [f"v{j}" for j in range(1, k + 1)]
    if k == 2:
        return o.select(F.col("src").alias("v1"), F.col("dst").alias("v2"))

    def run(table):
        import numpy as np

        x, out = blocks.Lists(table), []
        for u, near, i, j in x.links():
            if k == 3:
                out.append((np.full(len(i), x.ids[u]), x.ids[near[i]], x.ids[near[j]]))
            elif len(i):
                some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                i, j = at[: len(i)], at[len(i) :]
                linked = np.zeros((len(some), len(some)), bool)
                linked[i, j] = True
                names = x.ids[near[some]]
                step = max(1, blocks.CELLS // len(some))
                todo = [([i[lo : lo + step], j[lo : lo + step]], linked[i[lo : lo + step]] & linked[j[lo : lo + step]]) for lo in range(0, len(i), step)]
                while todo:
                    members, common = todo.pop()
                    row, w = np.nonzero(common)
                    members = [m[row] for m in members] + [w]
                    if len(members) == k - 1:
                        out.append((np.full(len(w), x.ids[u]), *(names[m] for m in members)))
                        continue
                    for lo in range(0, len(w), step):
                        part = slice(lo, lo + step)
                        todo.append(([m[part] for m in members], common[row[part]] & linked[w[part]]))
        return blocks.columns(out, " ".join(f"v{j}" for j in range(1, k + 1)))

    own = blocks.lists(o)
    return blocks.around(own, own, run, ", ".join(f"{c} long" for c in names))


def count_k_cliques(o: DataFrame, k: int) -> DataFrame:
    """One row: cliques. k = 1 counts ids, k = 2 edges; from 3 on the last level is counted, not made."""
    if k == 1:
        return o.sparkSession.createDataFrame([(n_of(o),)], "cliques long")
    if k == 2:
        return o.agg(F.count("*").alias("cliques"))
    adj = adjacency(o).select(F.col("v").alias("__v"), F.col("nbrs").alias("__n"))
    level = o.select(F.col("src").alias("v1"), F.col("dst").alias("v2")).join(adj.select(F.col("__v").alias("v1"), F.col("__n").alias("cand")), "v1")
    last = "v2"
    for i in range(2, k):
        cut = level.join(adj, F.col(last) == F.col("__v")).select(F.array_intersect("cand", "__n").alias("cand")).where(F.size("cand") >= k - i)
        if i == k - 1:
            return cut.agg(F.coalesce(F.sum(F.size("cand")), F.lit(0)).cast("long").alias("cliques"))
        last = f"v{i + 1}"
        level = cut.select("cand", F.explode("cand").alias(last))
    raise AssertionError


def search(later: set[int], earlier: set[int], links: dict[int, set[int]]) -> list[list[int]]:
    """Maximal cliques inside ``later`` that no vertex of ``earlier`` extends; pivoting on the vertex that leaves the
    fewest branches. Sets are bits of whole numbers."""
    names = sorted(later | earlier)
    place = {v: i for i, v in enumerate(names)}
    near = [0] * len(names)
    for v, others in links.items():
        if v in place:
            for w in others:
                if w in place:
                    near[place[v]] |= 1 << place[w]

    def bits(m):
        while m:
            low = m & -m
            yield low.bit_length() - 1
            m ^= low

    out: list[list[int]] = []
    todo = [((), sum(1 << place[v] for v in later), sum(1 << place[v] for v in earlier))]
    while todo:
        chosen, p, x = todo.pop()
        if not p:
            if not x:
                out.append([names[i] for i in chosen])
            continue
        pivot = max(bits(p | x), key=lambda i: (p & near[i]).bit_count())
        for i in bits(p & ~near[pivot]):
            todo.append(((*chosen, i), p & near[i], x & near[i]))
            p &= ~(1 << i)
            x |= 1 << i
    return out


class Grown:
    """Maximal cliques around many roots at once. A root's candidates are numbered, later ones first and by rank; its
    table of links has a row for each later one."""

    def __init__(self):
        self.parts, self.cells, self.rows = [], 0, 0

    def add(self, u: int, near, n: int, first, second) -> None:
        """Root, its candidates, ``n`` of them later, and the links of the later ones ``first``, in their order."""
        self.parts.append((u, near, n, first, second))
        self.cells += n * len(near)
        self.rows += len(first)

    def cliques(self):
        """Arrays of cliques of one size each: a row a clique, of places."""
        import numpy as np

        if not self.parts:
            return
        roots = np.array([p[0] for p in self.parts])
        names = np.concatenate([p[1] for p in self.parts])
        wide, late, linked = (np.array([len(p[i]) if i != 2 else p[i] for p in self.parts], np.int64) for i in (1, 2, 3))
        at, table, begins = np.cumsum(wide) - wide, np.cumsum(wide * late) - wide * late, np.cumsum(late) - late
        y, row = (np.concatenate([p[i] for p in self.parts]).astype(np.int64) for i in (4, 3))
        of = np.repeat(np.arange(len(roots)), linked)
        links = np.zeros(self.cells, bool)
        links[table[of] + row * wide[of] + y] = True
        self.__init__()

        def open_ones(root, members, state, y, later):
            """Of the states, those that may grow; cliques that nothing extends are kept."""
            full = np.bincount(state, minlength=len(root)) == 0
            if full.any():
                done.append(np.column_stack([roots[root[full]], names[at[root[full]][:, None] + members[full]]]))
            grow = np.bincount(state[later], minlength=len(root)) > 0
            if grow.any():
                kept = grow[state]
                todo.append((root[grow], members[grow], (np.cumsum(grow) - 1)[state[kept]], y[kept], later[kept]))

        todo, done = [], []
        root = np.repeat(np.arange(len(roots)), late)
        members = (np.arange(len(root)) - begins[root])[:, None]
        open_ones(root, members, begins[of] + row, y, (y > row) & (y < late[of]))
        while todo:
            root, members, state, y, later = todo.pop()
            size = np.bincount(state, minlength=len(root))
            cost = np.cumsum(size * np.bincount(state[later], minlength=len(root)))
            if cost[-1] > PAIRS and len(root) > 1:
                cut = max(1, int(np.searchsorted(cost, PAIRS, side="right")))
                cut = min(cut, len(root) - 1)
                mid = int(size[:cut].sum())
                todo.append((root[cut:], members[cut:], state[mid:] - cut, y[mid:], later[mid:]))
                root, members, state, y, later, size = root[:cut], members[:cut], state[:mid], y[:mid], later[:mid], size[:cut]
            begin = np.cumsum(size) - size
            ones = np.flatnonzero(later)  # each against all of its state
            s = state[ones]
            many = size[s]
            a = np.repeat(np.arange(len(ones)), many)
            b = np.arange(len(a)) + np.repeat(begin[s] - np.cumsum(many) + many, many)
            cell = table[root[s]] + y[ones] * wide[root[s]]
            hit = links[cell[a] + y[b]]
            a, b = a[hit], b[hit]
            near = np.bincount(b, minlength=len(state))
            best = np.flatnonzero(near == np.maximum.reduceat(near, begin)[state])
            pivot = best[np.unique(state[best], return_index=True)[1]]
            branch = ~links[cell + y[pivot][s]]
            before = np.zeros(len(state), bool)
            before[ones[branch]] = True
            go = branch[a]
            a, b = a[go], b[go]
            s = s[branch]
            open_ones(root[s], np.column_stack([members[s], y[ones[branch]]]), (np.cumsum(branch) - 1)[a], y[b], later[b] & ~(before[b] & (b < ones[a])))
            yield from done
            done.clear()
        yield from done


def _maximal_of(table):
    """members of the maximal cliques in which a block's own vertex comes first, by ``value``."""
    import numpy as np
    import pyarrow as pa

    v, mine = table.column("v").to_numpy(), table.column("own").to_numpy()
    size, flat = blocks.Lists.flat(table.column("nbrs"))
    x = blocks.Lists.over(blocks.Lists.different(v, flat[:0]))
    known = np.empty(len(flat), bool)  # what own vertices lead to, and they
    for lo in range(0, len(flat), blocks.PIECE):
        known[lo : lo + blocks.PIECE] = np.isin(flat[lo : lo + blocks.PIECE], x.ids)
    many = np.concatenate([np.zeros(1, np.int32), np.cumsum(known, dtype=np.int32)])
    ends = np.cumsum(size)
    all_of = x.csr(v, (many[ends] - many[ends - size]).astype(np.int64), flat[known])
    del flat, known, many, ends
    rank = np.empty(len(x.ids), np.int64)
    rank[np.searchsorted(x.ids, v)] = table.column("value").to_numpy()
    place = np.full(len(x.ids), -1, np.int32)
    found, sizes, grown = [], [], Grown()

    def keep():
        for c in grown.cliques():
            found.append(np.sort(x.ids[c], axis=1).ravel())
            sizes.append(np.full(len(c), c.shape[1]))

    for u in np.searchsorted(x.ids, v[mine]).tolist():
        near = x.of(u, all_of)
        near = near[np.argsort(rank[near])]
        first = int(np.searchsorted(rank[near], rank[u]))
        near, n = np.concatenate([near[first:], near[:first]]), len(near) - first
        if not n:
            continue
        if n > MOST_LATER:
            raise ValueError(f"vertex {x.ids[u]} has {n} later neighbours")
        place[near] = np.arange(len(near), dtype=np.int32)
        first, ends = x.joined(near[:n], all_of)
        second = place[ends]
        place[near] = -1
        hit = np.flatnonzero(second >= 0)
        first, second = first[hit], second[hit]
        if n * len(near) <= 4 * PAIRS:
            grown.add(u, near, n, first, second)
            if grown.cells > 4 * PAIRS or grown.rows > PAIRS // 2:
                keep()
            continue
        links: dict[int, set[int]] = {i: set() for i in range(n)}
        for a, b in zip(first.tolist(), second.tolist()):
            links[a].add(b)
            links.setdefault(b, set()).add(a)
        for c in search(set(range(n)), set(links) - set(range(n)), links):
            found.append(np.sort(np.append(x.ids[near[c]], x.ids[u])))
            sizes.append(np.array([len(c) + 1]))
    keep()
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes])).astype(np.int32)
    return pa.table({"members": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))})


def maximal_cliques(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """members (ascending) of every maximal clique; isolated ids are cliques of one.

    ``ranks`` (v, rank) orders vertices totally; with a degeneracy order each search stays small. A search gets the
    links among one vertex's neighbours and returns the cliques in which that vertex comes first.
    """
    spark = edges.sparkSession
    simple = canonical_table(edges)
    m, n = simple.count(), n_of(simple)
    both = both_directions(simple).select("src", F.col("dst").cast("int" if n < 1 << 31 else "long").alias("dst"))
    both._edgeloom_path = simple._edgeloom_path  # read from there again, without a table of its own
    own = blocks.lists(both, per=CLIQUE_ENDS)
    values = global_rank(ranks.select("v", "rank"), "rank", name="value")

    cliques = blocks.among(own, values, _maximal_of, "members array<long>", 2 * m)
    alone = spark.range(n).select(F.col("id").alias("v")).join(own.select("v"), "v", "left_anti")
    return cliques.unionByName(alone.select(F.array("v").alias("members")))


def clique_report(cliques: DataFrame) -> DataFrame:
    return cliques.agg(F.count("*").alias("cliques"), F.max(F.size("members")).cast("long").alias("largest"))
