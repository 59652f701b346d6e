"""Sequential orders against plain versions of their rules: no heaps, no queues of pairs, everything looked at anew."""

import random
from math import log2

import pytest

from edgeloom.operators import metrics, orient, prepare, sequential


def graph(n, p, seed):
    r = random.Random(seed)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < p]
    g = sequential.Graph(n, pairs)
    return g, {v: sorted(b for a, b in pairs if a == v) for v in range(n)}, {v: sorted(a for a, b in pairs if b == v) for v in range(n)}


GRAPHS = [(1, 0.0, 1), (2, 1.0, 1), (40, 0.1, 2), (90, 0.05, 3), (150, 0.03, 4), (70, 0.3, 5)]


def plain_dfs(n, outs, ins):
    order, seen = [], set()

    def walk(u):
        seen.add(u)
        order.append(u)
        for v in outs[u]:
            if v not in seen:
                walk(v)

    for u in range(n):
        if u not in seen:
            walk(u)
    return order


def plain_levels(n, outs, roots, key):
    order = []
    for r in roots:
        if r in order:
            continue
        order.append(r)
        at = len(order) - 1
        while at < len(order):
            order += [v for v in sorted(outs[order[at]], key=key) if v not in order]
            at += 1
    return order


def plain_bfs(n, outs, ins):
    return plain_levels(n, outs, sorted(range(n), key=lambda v: (-len(outs[v]), v)), lambda v: v)


def plain_rcm(n, outs, ins):
    key = lambda v: (len(outs[v]) + len(ins[v]), v)
    return plain_levels(n, outs, sorted(range(n), key=key), key)[::-1]


def plain_hybrid(n, outs, ins):
    walk = plain_bfs(n, outs, ins)
    return sorted(range(n), key=lambda v: (-len(outs[v]) - len(ins[v]), walk.index(v)))


def plain_greedy_naive(n, outs, ins):
    order = []
    for u in plain_rcm(n, outs, ins):
        order += [v for v in sorted(outs[u], key=lambda v: (-len(outs[v]) - len(ins[v]), v)) if v not in order]
    return order + [v for v in range(n) if v not in order]


def plain_gro(n, outs, ins):
    order = []
    while len(order) < n:
        if len(order) % 32 == 0:
            gain, since, clock, used_in, used_out = dict.fromkeys(range(n), 0), {v: v for v in range(n)}, n, set(), set()
            u = min((v for v in range(n) if v not in order), key=lambda v: (-len(outs[v]) - len(ins[v]), v))
        else:
            u = min((v for v in range(n) if v not in order), key=lambda v: (-gain[v], since[v]))
        order.append(u)
        for near, used, far in ((ins, used_in, outs), (outs, used_out, ins)):
            for v in near[u]:
                if v in used:
                    continue
                used.add(v)
                for w in far[v]:
                    if w not in order:
                        clock += 1
                        gain[w], since[w] = gain[w] + 1, clock
    return order


def plain_slashburn(n, outs, ins):
    k = max(1, min(n // 1024, 1024))
    number, lo, hi = {}, 0, n - 1
    degree = {v: len(outs[v]) for v in outs}
    while hi - lo + 1 >= k and lo <= hi:
        hubs = []
        for _ in range(k):
            h = max((v for v in range(n) if v not in number), key=lambda v: (degree[v], v))
            number[h] = lo
            lo += 1
            hubs.append(h)
            for w in outs[h]:
                degree[w] -= 1
        group, groups = {}, []
        for i, h in enumerate(hubs):
            for s in outs[h]:
                if s in number or s in group:
                    continue
                part, at = [s], 0
                group[s] = len(groups)
                while at < len(part):
                    for w in outs[part[at]]:
                        if w not in number and w not in group:
                            group[w] = len(groups)
                            part.append(w)
                    at += 1
                groups.append((i, len(part), part))
        groups.sort(key=lambda x: (x[0], x[1]))
        largest = max((x[1] for x in groups), default=0)
        kept = False
        for _, size, part in groups:
            if size == largest and not kept:
                kept = True
                continue
            for u in part:
                number[u] = hi
                hi -= 1
    for v in range(n):
        if v not in number:
            number[v] = lo
            lo += 1
    return sorted(range(n), key=number.get)


def plain_bfsr(n, outs, ins):
    def cut(part):
        size = len(part)
        if size < 32:
            return part
        walk = [part[0]]
        for u in walk:
            walk += [v for v in outs[u] if v in part and v not in walk]
        i = part.index(walk[-1])
        part = [part[i], *part[1:i], part[0], *part[i + 1 :]] if i else part
        taken, at = [], 0
        for s in part:
            if len(taken) >= size // 4:
                break
            if s in taken:
                continue
            taken.append(s)
            while at < len(taken) and len(taken) < size // 2:
                for v in outs[taken[at]]:
                    if v in part and v not in taken:
                        taken.append(v)
                        if 4 * len(taken) >= 3 * size:
                            break
                at += 1
        part = list(part)
        a, b = 0, len(taken)
        while True:
            while a < len(taken) and part[a] in taken:
                a += 1
            while b < size and part[b] not in taken:
                b += 1
            if a >= len(taken) or b >= size:
                break
            part[a], part[b] = part[b], part[a]
        return cut(part[: len(taken)]) + cut(part[len(taken) :])

    return cut(list(range(n)))


def plain_mloggapa(n, outs, ins):
    f = lambda n1, q1, n2, q2: q1 * log2(n1 / (q1 + 1)) + q2 * log2(n2 / (q2 + 1)) if q1 >= 0 and q2 >= 0 else 0.0

    def cut(part):
        if len(part) < 32:
            return part
        a, b = part[: len(part) // 2], part[len(part) // 2 :]
        for _ in range(20):
            gain = dict.fromkeys(part, 0.0)
            for lists in (ins, outs):
                for q in range(n):
                    left, right = [v for v in a if q in lists[v]], [v for v in b if q in lists[v]]
                    if left or right:
                        now = f(len(a), len(left), len(b), len(right))
                        for v in left:
                            gain[v] += now - f(len(a), len(left) - 1, len(b), len(right) + 1)
                        for v in right:
                            gain[v] += now - f(len(a), len(left) + 1, len(b), len(right) - 1)
            pairs = list(zip(sorted(range(len(a)), key=lambda i: (-round(gain[a[i]], 9), a[i])), sorted(range(len(b)), key=lambda i: (-round(gain[b[i]], 9), b[i]))))
            swaps = []
            for i, j in pairs:
                if gain[a[i]] + gain[b[j]] <= 1e-12:
                    break
                swaps.append((i, j))
            for i, j in swaps:
                a[i], b[j] = b[j], a[i]
            if not swaps:
                break
        return cut(a) + cut(b)

    return cut(list(range(n)))


PLAIN = {
    "dfs": plain_dfs, "bfs": plain_bfs, "rcm": plain_rcm, "hybrid": plain_hybrid, "greedy_naive": plain_greedy_naive, "gro": plain_gro, "slashburn": plain_slashburn, "bfsr": plain_bfsr,
    "mloggapa": plain_mloggapa,
}


@pytest.mark.parametrize("method", sorted(PLAIN))
def test_orders(method):
    for n, p, seed in GRAPHS:
        g, outs, ins = graph(n, p, seed)
        assert sequential.METHODS[method](g) == PLAIN[method](n, outs, ins), (method, n)


def test_orders_of_larger_graphs():
    g, outs, ins = graph(2100, 0.002, 6)  # two hubs a round
    assert sequential.slash_burn(g) == plain_slashburn(2100, outs, ins)
    assert sorted(sequential.partition_order(g)) == list(range(2100))  # a stand-in for an external partitioner: no rule to hold it to


def test_bucket_order_by_looking_at_all_buckets(spark):
    g, outs, ins = graph(300, 0.06, 7)
    pairs = [(u, v) for u in outs for v in outs[u]]
    o = orient.by_degree(prepare.canonical_edges(spark.createDataFrame(pairs, "src long, dst long")), "larger_id_first")
    degree = dict.fromkeys(range(prepare.n_of(o)), 0)
    for r in o.collect():
        degree[r["src"]] += 1
    long = sorted((v for v in degree if degree[v] >= 2), key=lambda v: (degree[v], v))
    m, few = len(long) // 40, sum(degree[v] < 5 for v in long)
    buckets, surplus = [[] for _ in range(m)], [0.0] * m
    over = lambda k: (metrics.bandwidth(k) - metrics.balance(k)) / 40
    for v in long[: 40 * m][few:][::-1]:
        b = min((b for b in range(m) if len(buckets[b]) < 40), key=lambda b: (surplus[b], b))
        buckets[b].append(v)
        surplus[b] += over(degree[v])
    for v in long[: min(few, 40 * m)]:
        b = max((b for b in range(m) if len(buckets[b]) < 40), key=lambda b: (surplus[b], b))
        buckets[b].append(v)
        surplus[b] += over(degree[v])
    want = [v for b in buckets[::-1] for v in b] + long[40 * m :] + [v for k in (1, 0) for v in sorted(degree) if degree[v] == k]
    got = {r["new_id"]: r["old_id"] for r in sequential.bucket_balance(o).collect()}
    assert [got[i] for i in range(len(want))] == want and m > 2 and 0 < few < 40 * m


@pytest.mark.parametrize("method", sorted(sequential.METHODS))
def test_graphs_beyond_what_a_task_holds(spark, monkeypatch, method):
    """Lists in a file, parts on arrays and on lists, few entries at a time: the same order. No size is refused."""
    _, outs, ins = graph(90, 0.15, 8)
    pairs = [(a, b) for a in outs for b in outs[a]]
    table = spark.createDataFrame(pairs, "src long, dst long").repartition(5)
    want = sequential.METHODS[method](sequential.Graph(90, pairs))
    if method in PLAIN:
        assert want == PLAIN[method](90, outs, ins)
    for held in (3, len(pairs)):
        got = {r["new_id"]: r["old_id"] for r in sequential.reorder(table, method, held=held).collect()}
        assert [got[i] for i in range(90)] == want, held
    for name, value in (("SMALL", 0), ("STEP", 5), ("AHEAD", 2)):
        monkeypatch.setattr(sequential, name, value)
    assert sequential.METHODS[method](sequential.Graph(90, pairs)) == want
    repeated = sequential.METHODS[method](sequential.Graph(90, pairs + pairs[::3] + [(4, 4)]))
    assert sorted(repeated) == list(range(90))


@pytest.mark.parametrize("method", ["dfs", "bfs", "rcm", "slashburn", "bfsr", "gro"])
def test_repeated_edges_and_loops(method):
    _, outs, ins = graph(60, 0.1, 9)
    pairs = [(a, b) for a in outs for b in outs[a]] * 2 + [(7, 7)]
    outs = {v: sorted(b for a, b in pairs if a == v) for v in range(60)}
    ins = {v: sorted(a for a, b in pairs if b == v) for v in range(60)}
    unlike = lambda rows: {v: sorted(set(r)) for v, r in rows.items()}
    plain = (outs, ins) if method in ("slashburn", "gro") else (unlike(outs), unlike(ins))
    if method in ("bfs", "rcm"):  # the plain walk looks at a list's repeats at once
        order = {"bfs": lambda: plain_levels(60, plain[0], sorted(range(60), key=lambda v: (-len(outs[v]), v)), lambda v: v)}
        order["rcm"] = lambda: plain_levels(60, plain[0], sorted(range(60), key=key), key)[::-1]
        key = lambda v: (len(outs[v]) + len(ins[v]), v)
        want = order[method]()
    else:
        want = PLAIN[method](60, *plain)
    assert sequential.METHODS[method](sequential.Graph(60, pairs)) == want


@pytest.mark.parametrize("many", [0, 3])
def test_window_greedy_seeks_among_the_highest(monkeypatch, many):
    """The next pick is sought among few; where those are used up, among all again. Ties as in the plain rule."""
    monkeypatch.setattr(sequential, "MANY", many)
    for n, p, seed in [*GRAPHS, (120, 0.2, 10)]:
        g, outs, ins = graph(n, p, seed)
        assert sequential.window_greedy(g) == plain_gro(n, outs, ins), n
