"""Iterative orders: peeling waves with a growing threshold, and core numbers. Each round is a table in the shared
folder, so lineage stays short and executors may be lost."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import global_rank, materialize, replace, ship_package
from . import blocks
from .degree import degrees, with_isolated
from .orient import by_key
from .prepare import both_directions, canonical_edges, canonical_table, n_of, vertices
from .relabel import apply

MOST_ROUNDS = 100_000


def _start(edges: DataFrame):
    simple = materialize(canonical_edges(edges), "simple")
    every = vertices(edges)
    state = materialize(with_isolated(degrees(simple), every, "deg").select("v", F.col("deg").alias("res"), F.lit(None).cast("long").alias("prio")), "peel")
    return simple, materialize(both_directions(simple), "both"), state


def _wave(both: DataFrame, state: DataFrame, peeled) -> DataFrame:
    """Residuals of unpeeled vertices after those of the wave ``peeled`` (a condition on state) are gone."""
    gone = state.where(peeled).select(F.col("v").alias("src"))
    loss = both.join(gone, "src", "left_semi").groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("loss"))
    return state.join(loss, "v", "left").select("v", F.when(F.col("prio").isNull(), F.col("res") - F.coalesce("loss", F.lit(0))).otherwise(F.col("res")).alias("res"), "prio")


def peel_priority(edges: DataFrame, initial: float = 1.0, growth: float = 1.0) -> DataFrame:
    """v, priority, residual of every id. Waves take all vertices whose residual degree is within the threshold; when a
    wave is empty the threshold grows. ``initial`` and ``growth`` scale the first threshold, half an edge above the
    mean degree over 2, and its growth."""
    simple, both, state = _start(edges)
    m, n = simple.count(), state.count()
    if not n:
        return state.select("v", F.col("prio").alias("priority"), F.col("res").alias("residual"))
    base = 2 * m / n + 1  # on the doubled degrees of a symmetric list
    threshold, step = initial * base / 2, max(0.5, growth * floor(initial * base) / 2)
    prio, left = 0, n
    for _ in range(MOST_ROUNDS):
        state = replace(state, state.withColumn("prio", F.when(F.col("prio").isNull() & (F.col("res") <= threshold), F.lit(prio)).otherwise(F.col("prio")).cast("long")), "peel")
        taken = state.where(F.col("prio") == prio).count()
        prio += 1
        while taken:
            left -= taken
            after = _wave(both, state, F.col("prio") == prio - 1)
            state = replace(state, after.withColumn("prio", F.when(F.col("prio").isNull() & (F.col("res") <= threshold), F.lit(prio)).otherwise(F.col("prio")).cast("long")), "peel")
            taken = state.where(F.col("prio") == prio).count()
            prio += 1
        if left <= 0:
            return state.select("v", F.col("prio").alias("priority"), F.col("res").alias("residual"))
        threshold += step
    raise RuntimeError("peeling did not end")


def peel_direction(edges: DataFrame, initial: float = 1.0, growth: float = 1.0) -> DataFrame:
    """Edges from the lower peel priority to the higher; ties from the smaller id."""
    return by_key(canonical_edges(edges), peel_priority(edges, initial, growth), "priority", "v")


def depth_priority(edges: DataFrame, share: float = 0.9, rounds: int = 50, deepest: int = 255) -> DataFrame:
    """v, major, minor: peeling by frontiers with thresholds that deepen when a frontier is small; what is left after
    ``share`` of all vertices, ``rounds`` rounds or the deepest threshold comes last, by its first degree."""
    simple, both, state = _start(edges)
    m, n = simple.count(), state.count()
    t = int(m / max(n, 1))
    first = state.select("v", F.col("res").alias("deg"))
    depth, major, seen = 1, 0, 0
    while n and seen < share * n and major < rounds:
        least = state.where("prio is null").agg(F.min("res")).first()[0]
        if least is None or (least > 0 and t == 0):
            break
        depth = max(depth, -(-least // t) if t else depth)
        if depth > deepest:
            break
        major += 1
        now = materialize(state.withColumn("prio", F.when(F.col("prio").isNull() & (F.col("res") <= t * depth), F.lit(major)).otherwise(F.col("prio")).cast("long")), "peel")
        taken = now.where(F.col("prio") == major).count()
        seen += taken
        if taken <= n / 500:
            depth += 1
        state = replace(now, _wave(both, now, F.col("prio") == major), "peel")
    last = F.lit(2**32 - 1).cast("long")
    return state.join(first, "v").select("v", F.coalesce("prio", last).alias("major"), F.when(F.col("prio").isNull(), F.col("deg")).otherwise(F.col("res")).alias("minor"))


def depth_direction(edges: DataFrame) -> DataFrame:
    return by_key(canonical_edges(edges), depth_priority(edges), "major", "minor", "v")


def peel_relabel(edges: DataFrame) -> DataFrame:
    """Both directions of each edge under new ids n - 1 - rank by (priority, residual, id)."""
    p = peel_priority(edges)
    ranked = global_rank(p, F.desc("priority"), F.desc("residual"), F.desc("v"))
    return both_directions(apply(canonical_edges(edges), ranked.select(F.col("v").alias("old_id"), F.col("rank").alias("new_id"))))


def truncated_priority(edges: DataFrame, growth: float = 5.0, waves: int = 6, least: int = 200) -> DataFrame:
    """v, priority, residual of every id, with few waves a threshold. The first threshold is the mean degree; it grows
    by its whole part times growth / 5. After each scan at most ``waves`` waves run, and only while the vertices whose
    neighbours don't know yet are more than ``least`` and n / 5000; the others wait for the next threshold."""
    simple, both, state = _start(edges)
    m, n = simple.count(), state.count()
    state = replace(state, state.withColumn("told", F.lit(False)), "peel")
    threshold = 2 * m / max(n, 1)
    step, prio, left = max(0.5, int(threshold) * growth / 5), 0, n

    def scan(table):
        new = F.col("prio").isNull() & (F.col("res") <= threshold)
        return table.select("v", "res", F.when(new, F.lit(prio)).otherwise(F.col("prio")).cast("long").alias("prio"), "told")

    while left:
        state, prio, inner = replace(state, scan(state), "peel"), prio + 1, 0
        while True:
            seen = state.agg(F.count("prio").alias("peeled"), F.sum((F.col("prio").isNotNull() & ~F.col("told")).cast("long")).alias("untold")).first()
            left = n - seen["peeled"]
            if not left or inner >= waves or seen["untold"] <= max(least, n // 5000):
                break
            news = state.where("prio is not null and not told").select(F.col("v").alias("src"))
            loss = both.join(news, "src", "left_semi").groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("loss"))
            after = state.join(loss, "v", "left").select("v", F.when(F.col("prio").isNull(), F.col("res") - F.coalesce("loss", F.lit(0))).otherwise(F.col("res")).alias("res"), "prio", F.col("prio").isNotNull().alias("told"))
            state, prio, inner = replace(state, scan(after), "peel"), prio + 1, inner + 1
        threshold += step
    return state.select("v", F.col("prio").alias("priority"), F.col("res").alias("residual"))


def _cores_of(table):
    """v, core: numbers of a block's vertices, given those of their neighbours elsewhere, at the h-index's fixed point."""
    import numpy as np
    import pyarrow as pa

    x, value = _values(table)
    size = x.own[1]
    inner, held, now = np.zeros(len(value), bool), np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    inner[x.starts] = True
    first, near = x.joined(x.starts, x.own)
    held[x.starts] = np.bincount(first, value[near] >= value[x.starts][first], len(x.starts))
    todo = x.starts[held[x.starts] < value[x.starts]]
    while len(todo):
        first, near = x.joined(todo, x.own)
        before = value[todo]
        wide = int(before.max()) + 1
        ordered = np.sort(first * wide + (wide - 1 - np.minimum(value[near], before[first])))
        place = np.arange(len(ordered)) - (np.cumsum(size[todo]) - size[todo])[first] + 1
        value[todo] = np.bincount(first, wide - 1 - ordered % wide >= place, len(todo)).astype(np.int64)
        held[todo] = np.bincount(first, value[near] >= value[todo][first], len(todo))
        now[todo] = True  # others lose those that fell below them
        lost = inner[near] & ~now[near] & (before[first] >= value[near]) & (value[near] > value[todo][first])
        now[todo] = False
        hit = near[lost]
        held -= np.bincount(hit, minlength=len(held))
        todo = np.union1d(todo, hit)
        todo = todo[held[todo] < value[todo]]
    return pa.table({"v": x.ids[x.starts], "value": value[x.starts]})


def _rounds_of(table):
    """v, value: waves of a block's vertices, given those of their neighbours elsewhere: as many of a vertex's shell as
    it has too many (others) leave in waves before its own. From 0 upwards to the least fixed point."""
    import numpy as np
    import pyarrow as pa

    x, value = _values(table)
    size = x.own[1]
    over, held, now = np.zeros(len(value), np.int64), np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    mine = table.column("own").to_numpy()
    over[np.searchsorted(x.ids, table.column("v").to_numpy()[mine])] = table.column("over").to_numpy()[mine]
    late = x.starts[over[x.starts] > 0]
    inner = np.zeros(len(value), bool)
    inner[late] = True
    first, near = x.joined(late, x.own)
    held[late] = np.bincount(first, value[near] < value[late][first], len(late))
    todo = late[held[late] < over[late]]
    while len(todo):
        first, near = x.joined(todo, x.own)
        before = value[todo]
        wide = int(value.max()) + 1
        ordered = np.sort(first * wide + value[near]) % wide
        value[todo] = ordered[np.cumsum(size[todo]) - size[todo] + over[todo] - 1] + 1
        held[todo] = np.bincount(first, value[near] < value[todo][first], len(todo))
        now[todo] = True  # others lose those that rose to them
        lost = inner[near] & ~now[near] & (before[first] < value[near]) & (value[near] <= value[todo][first])
        now[todo] = False
        hit = near[lost]
        held -= np.bincount(hit, minlength=len(held))
        todo = np.union1d(todo, hit)
        todo = todo[held[todo] < over[todo]]
    return pa.table({"v": x.ids[x.starts], "value": value[x.starts]})


def _values(table):
    """Lists of a block and the value of each place."""
    import numpy as np

    x = blocks.Lists(table)
    value = np.zeros(len(x.ids), np.int64)
    value[np.searchsorted(x.ids, table.column("v").to_numpy())] = table.column("value").to_numpy()
    return x, value


def _settle(own: DataFrame, state: DataFrame, run) -> DataFrame:
    """v, value where ``run`` moves nothing any more: each block settles by itself, then hears of its neighbours.
    ``own`` from ``blocks.lists``; ``state`` a table (v, value) of all its vertices. Values only rise or only fall."""
    need = materialize(own.select("block", F.explode("nbrs").alias("v")).unionByName(own.select("block", "v")).distinct(), "need")
    none = F.lit(None).cast("array<long>")
    total = None
    for _ in range(MOST_ROUNDS):
        now = state.agg(F.sum("value")).first()[0]
        if now == total:
            return state
        total = now
        known = need.join(state, "v")
        mine = own.join(known, ["block", "v"]).withColumn("own", F.lit(True))
        theirs = known.join(own.select("block", "v"), ["block", "v"], "left_anti").withColumn("own", F.lit(False)).withColumn("nbrs", none)
        met = mine.unionByName(theirs, allowMissingColumns=True).groupBy("block").applyInArrow(run, "v long, value long")
        state = replace(state, met, "value")
    raise RuntimeError("the values did not settle")


def _peeled(size, flat, step: int = 4_000_000):
    """core, round of each id by peeling in waves: ``flat`` holds the lists of all ids one after the other."""
    import numpy as np

    begin, left = np.cumsum(size) - size, size.copy()
    core, wave, alive = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32), np.ones(len(size), bool)
    rest, k = np.arange(len(size)), 0
    while len(rest):
        k = max(k, int(left[rest].min()))
        todo, t = rest[left[rest] <= k], 0
        while len(todo):
            alive[todo], core[todo], wave[todo] = False, k, t
            ends, lo, met = np.cumsum(size[todo]), 0, []
            while lo < len(todo):  # lists of ``step`` entries at a time, or a longer one
                done = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + step, side="right")))
                some = todo[lo:hi]
                near = flat[np.repeat(begin[some] - ends[lo:hi] + done + size[some], size[some]) + np.arange(int(ends[hi - 1]) - done)]
                hit, lost = np.unique(near[alive[near]], return_counts=True)
                left[hit] -= lost
                met.append(hit)
                lo = hi
            hit = met[0] if len(met) == 1 else np.unique(np.concatenate(met))
            todo, t = hit[left[hit] <= k], t + 1
        rest = rest[alive[rest]]
    return core, wave


def _peel_in_one_task(simple: DataFrame, m: int, n: int) -> DataFrame:
    """v, core, round of every id. One task gets all edges, keeps them in a file of its own until both directions
    stand as lists in memory, four bytes an edge and direction, and peels them."""
    ship_package(simple.sparkSession)

    def run(batches):
        import tempfile

        import numpy as np
        import pyarrow as pa

        with tempfile.TemporaryDirectory() as folder:
            with open(f"{folder}/ends", "wb") as file:
                for batch in batches:
                    np.column_stack([c.to_numpy() for c in batch.columns]).astype(np.int32).tofile(file)
            pairs = np.memmap(f"{folder}/ends", np.int32, "r", shape=(m, 2)) if m else np.empty((0, 2), np.int32)
            size = np.zeros(n, np.int64)
            for lo in range(0, m, blocks.PIECE * 4):
                size += np.bincount(pairs[lo : lo + blocks.PIECE * 4].ravel(), minlength=n)
            flat, free = np.empty(2 * m, np.int32), np.cumsum(size) - size
            for lo in range(0, m, blocks.PIECE * 4):
                some = pairs[lo : lo + blocks.PIECE * 4].astype(np.int64)
                keys = np.concatenate([some[:, 0] << 32 | some[:, 1], some[:, 1] << 32 | some[:, 0]])
                keys.sort()
                v = keys >> 32
                many = np.bincount(v, minlength=n)
                flat[(free - np.cumsum(many) + many)[v] + np.arange(len(v))] = (keys & 0xFFFFFFFF).astype(np.int32)
                free += many
            del pairs
        core, wave = _peeled(size, flat)
        del flat
        for lo in range(0, n, 1 << 17):
            part = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, min(n, lo + (1 << 17)))), pa.array(core[part]), pa.array(wave[part].astype(np.int64))], names=["v", "core", "round"])

    ends = simple.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    return ends.coalesce(1).mapInArrow(run, "v long, core long, round long")


#: edge ends in a block of ``core_numbers``
CORE_ENDS = 6_000_000
#: bytes that one task of ``core_numbers`` holds at most: 8 an edge, 48 an id; larger graphs settle in blocks
PEEL_BYTES = 800_000_000


def core_numbers(edges: DataFrame, rounds: bool = True) -> DataFrame:
    """v, core, round of every id. ``round`` is the wave of the vertices of equal core in which a vertex can leave; it is
    left out without ``rounds``.

    A graph of up to ``PEEL_BYTES`` is peeled in one task. In a larger one, a vertex's number is the largest k such that
    k neighbours have k or more (an h-index), from degrees down until nothing moves: the fixed point is the core number.
    Blocks of ids settle by themselves between rounds, so that numbers travel between blocks only. The waves of all
    shells are the least fixed point of a like rule.
    """
    simple = canonical_table(edges)
    m, n = simple.count(), n_of(simple)
    if n < 1 << 31 and 8 * m + 48 * n <= PEEL_BYTES:
        peeled = _peel_in_one_task(simple, m, n)
        return peeled if rounds else peeled.drop("round")
    every = vertices(simple)
    own = blocks.lists(materialize(both_directions(simple), "both"), per=CORE_ENDS, least=1)
    core = _settle(own, materialize(own.select("v", F.size("nbrs").cast("long").alias("value")), "value"), _cores_of)
    core = with_isolated(core.select("v", F.col("value").alias("core")), every, "core")
    if not rounds:
        return core
    core = materialize(core, "core")
    a, b = (core.select(F.col("v").alias(c), F.col("core").alias(f"c{c}")) for c in ("src", "dst"))
    links = materialize(both_directions(simple).join(a, "src").join(b, "dst").where("cdst >= csrc"), "links")
    # a vertex leaves when at most core neighbours of its own shell that are left and of higher ones remain
    over = links.groupBy(F.col("src").alias("v"), F.col("csrc").alias("c")).agg(F.count("*").alias("held")).select("v", (F.col("held") - F.col("c")).alias("over"))
    shell = blocks.lists(materialize(links.where("cdst = csrc").select("src", "dst"), "shell"), per=CORE_ENDS, least=1).join(over, "v")
    shell = materialize(shell, "shell")
    waves = _settle(shell, materialize(shell.select("v", F.lit(0).cast("long").alias("value")), "value"), _rounds_of)
    return core.join(waves, "v", "left").select("v", "core", F.coalesce("value", F.lit(0)).cast("long").alias("round"))


def degeneracy(cores: DataFrame) -> DataFrame:
    return cores.agg(F.max("core").alias("degeneracy"))


def degeneracy_order(cores: DataFrame) -> DataFrame:
    """v, rank by (core, round, id)."""
    return global_rank(cores, "core", "round", "v").select("v", "rank")


def core_direction(edges: DataFrame) -> DataFrame:
    simple = canonical_table(edges)
    core = core_numbers(simple, rounds=False)
    core = core if hasattr(core, "_edgeloom_path") else materialize(core, "core")
    a, b = (core.select(F.col("v").alias(c), F.col("core").alias(f"c{c}")) for c in ("src", "dst"))
    first = F.when(F.col("csrc") == F.col("cdst"), F.col("src") < F.col("dst")).otherwise(F.col("csrc") < F.col("cdst"))
    met = simple.join(a, "src").join(b, "dst")
    return met.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))
