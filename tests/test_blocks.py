"""Searches in blocks of ids: against every triple and subset, with many blocks, and without two-step paths in a shuffle."""

import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import blocks, cliques, patterns, peel, prepare, triangles


def random_graph(n, p, seed):
    r = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < p]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks.lists, "__defaults__", (None, 7, None))


@pytest.mark.parametrize("n, p, seed", [(30, 0.3, 1), (45, 0.15, 2), (12, 1.0, 3), (5, 0.0, 4)])
def test_triangles_of_many_blocks(spark, small_blocks, n, p, seed):
    pairs = random_graph(n, p, seed)
    near = set(pairs)
    want = {t for t in combinations(range(n), 3) if {t[:2], t[1:], (t[0], t[2])} <= near}
    o = triangles.directed(spark.createDataFrame(pairs, "src long, dst long"))
    rows = [tuple(r) for r in triangles.triangles(o).collect()]
    assert len(rows) == len(want) and {tuple(sorted(r)) for r in rows} == want
    for plan in triangles.PLANS:
        assert triangles.count_triangles(o, plan).first()[0] == len(want), plan


def test_two_step_paths_are_not_shuffled(spark):
    o = triangles.directed(spark.createDataFrame(random_graph(20, 0.5, 5), "src long, dst long"))
    for found in (triangles.triangles(o), triangles.packed_support(o)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "LeftSemi" not in plan
    # a list is sent to each block that needs it, once: two blocks at most here, whatever the number of edges
    assert triangles.partial_counts(o, 20, 2).count() <= 4


def plain_cores(n, pairs):
    """(core, wave in its shell) of each id by the definitions, everything looked at anew."""
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(n)}
    core, left = {}, set(range(n))
    for k in range(n + 1):
        while low := [v for v in left if len(near[v] & left) <= k]:
            core |= dict.fromkeys(low, k)
            left -= set(low)
    wave: dict = {}
    t = 0
    while len(wave) < n:
        out = [v for v in range(n) if v not in wave and sum(core[w] > core[v] or (core[w] == core[v] and w not in wave) for w in near[v]) <= core[v]]
        wave |= dict.fromkeys(out, t)
        t += 1
    return {v: (core[v], wave[v]) for v in range(n)}


@pytest.mark.parametrize("n, p, seed", [(40, 0.12, 6), (25, 0.4, 7)])
def test_cores_of_many_blocks(spark, monkeypatch, n, p, seed):
    monkeypatch.setattr(peel, "CORE_ENDS", 9)
    pairs = random_graph(n, p, seed)
    top = max(b for _, b in pairs) + 1
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert {r["v"]: (r["core"], r["round"]) for r in peel.core_numbers(edges).collect()} == plain_cores(top, pairs)
    assert peel.core_numbers(edges, rounds=False).columns == ["v", "core"]


@pytest.mark.parametrize("n, p, seed", [(40, 0.12, 6), (25, 0.4, 7), (9, 1.0, 8)])
def test_cores_in_one_task_and_in_blocks(spark, monkeypatch, n, p, seed):
    """A graph that fits one task takes no rounds; a larger one settles in blocks."""
    import numpy as np

    pairs = random_graph(n, p, seed)
    top = max(b for _, b in pairs) + 1
    edges, want = spark.createDataFrame(pairs, "src long, dst long"), plain_cores(top, pairs)
    near = [[b if a == v else a for a, b in pairs if v in (a, b)] for v in range(top)]
    core, wave = peel._peeled(np.array([len(x) for x in near]), np.array(sum(near, []), np.int32), step=3)
    assert dict(enumerate(zip(core.tolist(), wave.tolist()))) == want
    settle = peel._settle
    monkeypatch.setattr(peel, "_settle", lambda *_: pytest.fail("rounds"))
    assert {r["v"]: (r["core"], r["round"]) for r in peel.core_numbers(edges).collect()} == want
    directed = {tuple(r) for r in peel.core_direction(edges).collect()}
    assert directed == {(a, b) if (want[a][0], a) < (want[b][0], b) else (b, a) for a, b in pairs}
    monkeypatch.setattr(peel, "_settle", settle)
    monkeypatch.setattr(peel, "PEEL_BYTES", 0)
    monkeypatch.setattr(peel, "CORE_ENDS", 9)
    assert {r["v"]: (r["core"], r["round"]) for r in peel.core_numbers(edges).collect()} == want
    assert peel.core_numbers(edges.where("src < 0")).count() == 0


def test_cliques_of_many_blocks(spark, small_blocks):
    pairs = random_graph(18, 0.5, 8)
    near = set(pairs)
    sets = [c for k in range(1, 9) for c in combinations(range(18), k) if all(e in near for e in combinations(c, 2))]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for k in (4, 5):
        rows = [tuple(sorted(r)) for r in cliques.k_cliques(triangles.directed(edges), k).collect()]
        assert sorted(rows) == sorted(c for c in sets if len(c) == k)
    ranks = spark.createDataFrame([(v, v * 7 % 18) for v in range(18)], "v long, rank long")
    held = [set(c) for c in sets]
    want = sorted(tuple(c) for c in sets if not any(set(c) < h for h in held))
    found = cliques.maximal_cliques(edges, ranks)
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r[0]) for r in found.collect()) == want


PATTERNS = {
    "path3": ((0, 1, 0), ((0, 1), (1, 2))), "cycle4": ((0, 1, 0, 2), ((0, 1), (1, 2), (2, 3), (0, 3))), "one label": ((1, 1, 1, 1), ((0, 1), (1, 2), (2, 3), (0, 3))),
    "diamond": ((0, 1, 2, 1), ((0, 1), (0, 2), (1, 2), (1, 3), (2, 3))), "k4": ((0, 1, 2, 0), ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))),
    "star": ((2, 0, 1, 0), ((0, 1), (0, 2), (0, 3))), "house": ((0, 1, 2, 0, 1), ((0, 1), (1, 2), (2, 3), (0, 3), (0, 4), (1, 4))), "path6": ((0, 1, 2, 1, 0, 2), ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5))),
}


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_patterns_of_many_blocks(spark, monkeypatch, name, directed):
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 9)
    r = random.Random(11)
    n, pattern = 13, patterns.Pattern(*PATTERNS[name])
    stored = {p for p in permutations(range(n), 2) if r.random() < 0.5}
    if not directed:
        stored |= {(b, a) for a, b in stored}
    labels = [(v, r.randrange(3)) for v in range(n)] + [(3, 1), (4, 2)]  # a vertex can have two labels
    edges = spark.createDataFrame([*stored, (5, 5), min(stored)], "src long, dst long")
    table = spark.createDataFrame(sorted(set(labels)), "v long, label int")
    frequency = {x: sum(b == x for _, b in set(labels)) for x in range(3)}
    place = {q: i for i, q in enumerate(patterns.join_order(pattern, frequency))}
    along = [(a, b) if place[a] < place[b] else (b, a) for a, b in pattern.edges]
    want = sorted(m for m in permutations(range(n), len(pattern.labels)) if all((m[a], m[b]) in stored for a, b in along) and all((v, x) in labels for v, x in zip(m, pattern.labels)))
    found = patterns.match(edges, table, pattern)
    assert sorted(map(tuple, found.collect())) == want and want
    joined = "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert joined == (name == "path6")  # paths of the others are not shuffled


@pytest.mark.parametrize("sent", [1, 60])
def test_lists_are_sent_in_rounds(spark, monkeypatch, sent):
    """Ids that are not near: each block reaches most lists, which are never sent to all blocks at once."""
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 9)
    monkeypatch.setattr(blocks, "SENT", sent)
    monkeypatch.setattr(blocks, "PIECE", 3)
    r = random.Random(12)
    n, pattern = 16, patterns.Pattern(*PATTERNS["diamond"])
    stored = {p for p in permutations(range(n), 2) if r.random() < 0.6}
    stored |= {(b, a) for a, b in stored}
    label = [r.randrange(3) for _ in range(n)]
    want = sorted(m for m in permutations(range(n), 4) if all((m[a], m[b]) in stored for a, b in pattern.edges) and all(label[v] == x for v, x in zip(m, pattern.labels)))
    written = []
    monkeypatch.setattr(blocks, "materialize", lambda df, tag="step", f=blocks.materialize: written.append(tag) or f(df, tag))
    found = patterns.match(spark.createDataFrame([*stored], "src long, dst long").repartition(3), spark.createDataFrame(list(enumerate(label)), "v long, label int"), pattern)
    assert sorted(map(tuple, found.collect())) == want and want
    assert written.count("found") > 1


def test_raw_pairs_are_read_once(spark, tmp_path):
    """Patterns take repeated rows as they come, in both directions."""
    pairs = random_graph(40, 0.3, 13)
    raw = pairs + [(b, a) for a, b in pairs[::2]] + [(3, 3)]
    random.Random(14).shuffle(raw)
    spark.createDataFrame(raw, "src long, dst long").repartition(3).write.parquet(str(tmp_path / "raw"))
    edges = spark.read.parquet(str(tmp_path / "raw"))
    both = prepare.both_directions(edges)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert sorted(map(tuple, both.collect())) == sorted([*raw, *((b, a) for a, b in raw)])


def test_canonical_edges_stand_in_order(spark):
    """A table by ranges of its ends, sorted: a third of the room, and one exchange for order and comparison."""
    pairs = random_graph(40, 0.3, 15)
    raw = pairs + [(b, a) for a, b in pairs[::2]] + [(3, 3)]
    random.Random(16).shuffle(raw)
    table = prepare.canonical_table(spark.createDataFrame(raw, "src long, dst long").repartition(3))
    parts = [p["e"] for p in table.withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list(F.struct("src", "dst")).alias("e")).collect()]
    assert all(e == sorted(e) for e in parts)
    assert [tuple(x) for e in sorted(parts) for x in e] == pairs


@pytest.mark.parametrize("pairs_at_once", [1, 12, 60, 1 << 20])
def test_maximal_cliques_of_many_roots_at_once(monkeypatch, pairs_at_once):
    """Few pairs at a time, and roots that are searched by themselves, find the same."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(cliques, "PAIRS", pairs_at_once)
    for n, p, seed in ((14, 0.5, 21), (14, 0.8, 22), (9, 1.0, 23), (60, 0.1, 24)):
        pairs = random_graph(n, p, seed)
        near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(n)}
        names = [3 * v + 1 for v in range(n)]  # ids beyond those that the block has met are no candidates
        lists = [np.array(sorted(names[w] for w in near[v])) for v in range(n)]
        rank = np.random.default_rng(seed).permutation(n)
        table = pa.table({"v": names, "nbrs": pa.array([[*x, 1000] for x in lists], pa.list_(pa.int32())), "own": [True] * n, "value": rank})
        got = [tuple(x) for x in cliques._maximal_of(table).column(0).to_pylist()]
        want = {tuple(names[w] for w in sorted(c)) for c in map(frozenset, cliques.search(set(range(n)), set(), near)) if len(c) > 1}
        assert len(got) == len(set(got)) and set(got) == want


def test_each_list_goes_once_to_a_block(spark, monkeypatch):
    """What the maximal cliques send: of a clique of eight in two blocks, eight lists to each."""
    edges = spark.createDataFrame([(a, b) for a in range(8) for b in range(a)], "src long, dst long")
    simple = prepare.canonical_table(edges)
    own = blocks.lists(prepare.both_directions(simple), per=28, least=2)
    sent = blocks.among(own, spark.range(8).selectExpr("id as v", "id as value"), lambda t: t.select(["v"]), "v long", 0)
    assert sorted(r["v"] for r in sent.collect()) == sorted([*range(8)] * 2)


def test_maximal_cliques_in_rounds(spark, monkeypatch):
    """Where blocks reach more than may be sent at once, they run in rounds, and find the same."""
    monkeypatch.setattr(blocks, "SENT", 30)
    monkeypatch.setattr(cliques, "CLIQUE_ENDS", 20)
    pairs = random_graph(18, 0.4, 31)
    rounds, made = [], blocks.materialize
    monkeypatch.setattr(blocks, "materialize", lambda df, tag="step": (rounds.append(tag), made(df, tag))[1])
    found = cliques.maximal_cliques(spark.createDataFrame(pairs, "src long, dst long"), spark.range(20).selectExpr("id as v", "id * 7 % 20 as rank"))
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(18)}
    want = {tuple(sorted(c)) for c in cliques.search(set(range(max(map(max, pairs)) + 1)), set(), near)}
    got = [tuple(r[0]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and rounds.count("found") > 1
