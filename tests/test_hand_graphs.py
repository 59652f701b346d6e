"""Small graphs with known answers, and brute force for iterative and sequential operators."""

import random
from itertools import combinations

import pytest

from edgeloom.operators import cliques, degree, metrics, orient, patterns, peel, prepare, relabel, sequential, triangles
from edgeloom.sources import edge_files

GRAPHS = {
    "empty": ([], 0, 0, 0, 0, None),
    "single": ([(0, 1)], 2, 0, 0, 1, 1),
    "triangle": ([(0, 1), (1, 2), (0, 2)], 3, 1, 0, 1, 2),
    "path4": ([(0, 1), (1, 2), (2, 3)], 4, 0, 0, 3, 1),
    "star5": ([(0, 1), (0, 2), (0, 3), (0, 4)], 5, 0, 0, 4, 1),
    "diamond": ([(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], 4, 2, 0, 2, 2),
    "k4": (list(combinations(range(4), 2)), 4, 4, 1, 1, 3),
    "k5": (list(combinations(range(5), 2)), 5, 10, 5, 1, 4),
    "gap": ([(0, 2), (2, 3), (0, 3)], 4, 1, 0, 2, 2),
    "dirty": ([(0, 1), (1, 0), (0, 1), (2, 2), (1, 2), (0, 2)], 3, 1, 0, 1, 2),
}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def random_graph(n=24, p=0.3, seed=1):
    r = random.Random(seed)
    return [(a, b) for a, b in combinations(range(n), 2) if r.random() < p]


@pytest.mark.parametrize("name", GRAPHS)
def test_known_counts(spark, name):
    pairs, n, tri, k4, maximal, _ = GRAPHS[name]
    e = prepare.canonical_edges(frame(spark, pairs))
    assert prepare.n_of(e) == n
    o = triangles.directed(e)
    for plan in triangles.PLANS:
        assert triangles.count_triangles(o, plan).first()[0] == tri, plan
    assert cliques.count_k_cliques(o, 4).first()[0] == k4
    assert cliques.count_k_cliques(o, 2).first()[0] == e.count()
    ranks = degree.with_isolated(degree.degrees(e), prepare.vertices(e), "deg").selectExpr("v", "struct(deg, v) AS rank")
    assert cliques.maximal_cliques(e, ranks).count() == maximal


@pytest.mark.parametrize("name", ["star5", "diamond", "k5", "gap"])
def test_degeneracy(spark, name):
    e = prepare.canonical_edges(frame(spark, GRAPHS[name][0]))
    assert peel.degeneracy(peel.core_numbers(e)).first()[0] == GRAPHS[name][5]


def peeled(pairs, n, initial=1.0, growth=1.0):
    near = {v: set() for v in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    res = {v: len(near[v]) for v in near}
    base = 2 * len(pairs) / n + 1
    threshold, step, prio, p = initial * base / 2, max(0.5, growth * int(initial * base) / 2), {}, 0
    while len(prio) < n:
        wave = [v for v in near if v not in prio and res[v] <= threshold]
        prio.update(dict.fromkeys(wave, p))
        p += 1
        while wave:
            for v in wave:
                for w in near[v]:
                    if w not in prio:
                        res[w] -= 1
            wave = [v for v in near if v not in prio and res[v] <= threshold]
            prio.update(dict.fromkeys(wave, p))
            p += 1
        threshold += step
    return prio


def test_peeling_and_cores(spark):
    pairs = random_graph()
    e = frame(spark, pairs)
    assert {r["v"]: r["priority"] for r in peel.peel_priority(e).collect()} == peeled(pairs, 24)
    core, left = {}, set(range(24))
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in left}
    k = 0
    while left:
        v = min(left, key=lambda x: len(near[x] & left))
        k = max(k, len(near[v] & left))
        core[v] = k
        left.discard(v)
    assert {r["v"]: r["core"] for r in peel.core_numbers(e).collect()} == core
    tri = triangles.count_triangles(triangles.directed(e)).first()[0]
    for directed in (peel.peel_direction(e), peel.depth_direction(e), peel.core_direction(e)):
        assert directed.count() == len(pairs)
        assert triangles.count_triangles(directed, "array").first()[0] == tri


def test_maximal_cliques(spark):
    pairs = random_graph(16, 0.45, 3)
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(16)}
    every = [set(c) for k in range(1, 17) for c in combinations(range(16), k) if all(b in near[a] for a, b in combinations(c, 2))]
    maximal = {tuple(sorted(c)) for c in every if not any(c <= near[v] for v in range(16) if v not in c)}
    e = frame(spark, pairs)
    got = [tuple(r["members"]) for r in cliques.maximal_cliques(e, peel.degeneracy_order(peel.core_numbers(e))).collect()]
    assert len(got) == len(set(got)) and set(got) == maximal


@pytest.mark.parametrize("method", sorted(sequential.METHODS))
def test_orders_are_permutations(spark, method):
    for pairs in (random_graph(70, 0.08, 5), [(0, 5)]):
        e = frame(spark, pairs)
        got = sequential.reorder(e, method).collect()
        n = prepare.n_of(e)
        assert sorted(r["old_id"] for r in got) == sorted(r["new_id"] for r in got) == list(range(n))
    assert triangles.count_triangles(triangles.directed(relabel.apply(frame(spark, random_graph()), sequential.reorder(frame(spark, random_graph()), method)))).first()[0] == triangles.count_triangles(triangles.directed(frame(spark, random_graph()))).first()[0]


def test_sequential_bound(spark):
    with pytest.raises(ValueError):
        sequential.reorder(frame(spark, random_graph()), "dfs", most_edges=3)


def test_bucket_order(spark):
    e = orient.by_degree(prepare.canonical_edges(frame(spark, random_graph(200, 0.06, 9))), "larger_id_first")
    got = sequential.bucket_balance(e).collect()
    assert sorted(r["old_id"] for r in got) == sorted(r["new_id"] for r in got) == list(range(prepare.n_of(e)))


def test_rearranged_keeps_edges(spark):
    e = triangles.directed(frame(spark, random_graph(120, 0.4, 2)))
    b = metrics.edge_bins(metrics.edge_workload(e)).cache()
    for i in (1, 2, 4, 8, 16, 32):
        rows = metrics.rearranged(b, i, threads=256).collect()
        assert len(rows) == b.where(f"bin = {i}").count()
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_patterns_from_text():
    p = patterns.parse_patterns("3 2\n5 6 5\n1 0\n1 2\n2 1 7 8 0 1")
    assert p == [patterns.Pattern((5, 6, 5), ((0, 1), (1, 2))), patterns.Pattern((7, 8), ((0, 1),))]
    assert "3 vertices" in repr(p[0])


def test_label_and_count_files(spark, tmp_path):
    (tmp_path / "labels").write_text("9 4\n9 2\n9 7\n")
    assert sorted(map(tuple, edge_files.read_labels(spark, str(tmp_path / "labels")).collect())) == [(0, 4), (1, 2), (2, 7)]
    edge_files.write_match_counts(spark.createDataFrame([(0, 5)], "query_id int, n long"), str(tmp_path / "counts"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "counts")).collect()] == ["ans0=5"]
    edge_files.write_cliques(spark.createDataFrame([([1, 2, 5],)], "members array<long>"), str(tmp_path / "cliques"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "cliques")).collect()] == ["1 2 5"]


def test_comments_and_blank_lines(spark, tmp_path):
    (tmp_path / "edges").write_text("# made by hand\n1 2\n\n  3\t4 \n")
    assert sorted(map(tuple, edge_files.read_text_edges(spark, str(tmp_path / "edges"), comments=True).collect())) == [(1, 2), (3, 4)]


def test_binary_files_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(edge_files, "SPLIT", 64)
    rows = [(i, i * 7 % 50) for i in range(50)]
    edge_files.write_binary_edges(frame(spark, rows), str(tmp_path / "e"))
    reader = edge_files._EdgeReader(str(tmp_path / "e"), "src_first")
    parts = reader.partitions()
    assert len(parts) >= 7 and all((p.hi - p.lo) % 8 == 0 and p.hi - p.lo <= 64 for p in parts)
    assert sorted(e for p in parts for b in reader.read(p) for e in zip(*(c.to_pylist() for c in b.columns))) == sorted(rows)
    for bad in ([(-1, 2)], [(1, 1 << 32)]):
        with pytest.raises(Exception, match="ids from 0"):
            edge_files.write_binary_edges(frame(spark, bad), str(tmp_path / "bad"))


def test_degeneracy_order_and_cores(spark):
    """Each vertex has at most core-many neighbours later in the order."""
    for pairs in (random_graph(60, 0.2, 3), [(i, i + 1) for i in range(30)], GRAPHS["k5"][0] + [(4, 5), (5, 6)]):
        e = frame(spark, pairs)
        cores = peel.core_numbers(e)
        core = {r["v"]: r["core"] for r in cores.collect()}
        rank = {r["v"]: r["rank"] for r in peel.degeneracy_order(cores).collect()}
        for v in core:
            assert sum(rank[b if a == v else a] > rank[v] for a, b in pairs if v in (a, b)) <= core[v]


def test_direct_by_depth_last(spark):
    got = peel.depth_priority(frame(spark, [(0, i) for i in range(1, 30)])).collect()
    assert len(got) == 30 and max(got, key=lambda r: (r["major"], r["minor"]))["v"] == 0


def test_pairs_of_ranges(spark):
    pairs = random_graph(50, 0.3, 8)
    o = triangles.directed(frame(spark, pairs))
    whole = triangles.count_triangles(o, "semi").first()[0]
    for parts in (1, 3, 7, 50, 60):
        got = triangles.partial_counts(o, 50, parts).collect()
        assert sum(r["triangles"] for r in got) == whole and all(0 <= r["m"] < parts and 0 <= r["k"] < parts for r in got)


def test_binary_files(spark, tmp_path):
    pairs = [(0, 4_000_000_000), (7, 1)]
    for order in ("src_first", "hi_first"):
        path = str(tmp_path / order)
        edge_files.write_binary_edges(frame(spark, pairs), path, order)
        assert sorted(map(tuple, edge_files.read_binary_edges(spark, path, order).collect())) == sorted(pairs)
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "x.bin").write_bytes(b"123456789")
    with pytest.raises(ValueError):
        edge_files.read_binary_edges(spark, str(tmp_path / "short"))


def test_snake_shuffle_is_a_permutation(spark):
    got = relabel.snake_order(frame(spark, random_graph(150, 0.1, 4)), 8, seed=3).collect()
    assert sorted(r["new_id"] for r in got) == list(range(150))
