"""Exact top-k search by distributed histogram selection.

Queries come in blocks of a fixed size. For each block every candidate is scored in every round: partitions count all
scores in each query's present range into equal bins, the counts are summed over all partitions, and the bin that
holds the k-th largest score becomes the next range, until a bin is a single value. Where more rows have that value
than are needed, the same rounds go over their ids, to the largest id that is needed. Then one pass filters: scores
above the value, and rows of the value up to that id. Nothing else cuts the result.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; a vector with a
null id is no candidate and no query; vectors of another length than the query's are no candidates for it; a
repeated id is one query (its smallest vector) but each of its rows is a candidate for others; a query with fewer than
k candidates gets them all; other columns are ignored; an empty table gives an empty result. Scores from 2**53 on are
added up from halves of the components, exact up to the 63 bits that a long holds; beyond, ValueError.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship_package

QUERY_BLOCK = 2048
#: bits that a round settles: 2 ** BITS bins
BITS = 10


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, v: floor(scale * component) of each usable vector."""
    e = F.col(embedding)
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _matrices(batch):
    """(ids, int64 matrix) for each vector length in an Arrow batch."""
    import numpy as np

    ids = batch.column(0).to_numpy()
    v = batch.column(1)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(v.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield ids[at], flat[starts[at][:, None] + np.arange(d)]


def products(q, m, wide: bool):
    """Inner products of the rows of two int64 matrices, as int64. With ``wide`` from halves, exact below 2 ** 63."""
    import numpy as np

    if not wide:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    (qh, ql), (mh, ml) = (((x >> 16).astype(np.float64), (x & 0xFFFF).astype(np.float64)) for x in (q, m))
    return ((qh @ mh.T).astype(np.int64) << 32) + ((qh @ ml.T + ql @ mh.T).astype(np.int64) << 16) + (ql @ ml.T).astype(np.int64)


def _scored(batches, q_ids, q_mats, wide):
    """(rows of queries, candidate ids, scores, whether the candidate isn't the query itself) for slices of candidates."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            for ids, m in _matrices(batch.slice(i, 1024)):
                if m.shape[1] in q_mats:
                    at, q = q_mats[m.shape[1]]
                    yield at, ids, products(q, m, wide), q_ids[at][:, None] != ids[None, :]


def _histogram(vectors: DataFrame, shared, need) -> dict[int, tuple[int, int, int]]:
    """For each query the bin of its range that holds the ``need``-th largest key: (bin, keys above it, keys in it).

    The range is [low, low + 2 ** bits); keys are scores, or with ``value`` given the complements of the ids that
    score it, so that small ids come first.
    """
    spark = vectors.sparkSession

    def count(batches):
        import numpy as np
        import pyarrow as pa

        q_ids, q_mats, wide, low, bits, value, active = shared.value
        total = np.zeros((len(q_ids), 1 << BITS), np.int64)
        for at, ids, s, ok in _scored(batches, q_ids, q_mats, wide):
            own = active[at]
            at, s, ok = at[own], s[own], ok[own]
            key = s
            if value is not None:
                ok &= s == value[at][:, None]
                key = np.broadcast_to(~ids[None, :], s.shape)
            ok &= key >= low[at][:, None]
            past = (key - low[at][:, None]).view(np.uint64)
            if bits < 64:
                ok &= past >> np.uint64(bits) == 0
            row, col = np.nonzero(ok)
            bins = (past[row, col] >> np.uint64(max(0, bits - BITS))).astype(np.int64)
            total += np.bincount(at[row] << BITS | bins, minlength=total.size).reshape(total.shape)
        q, bins = np.nonzero(total)
        for i in range(0, len(q), 100_000):
            a, b = q[i : i + 100_000], bins[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["q", "bin", "n"])

    summed = vectors.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    wanted = spark.createDataFrame([(int(q), int(n)) for q, n in need.items()], "q int, need long")
    falling = summed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("h"))  # 2 ** BITS at most
    walk = "aggregate(h, struct(-1 AS bin, 0L AS above, 0L AS n), (a, x) -> if(a.bin >= 0, a, if(a.above + x.n >= need, struct(x.bin AS bin, a.above AS above, x.n AS n), struct(-1 AS bin, a.above + x.n AS above, 0L AS n))))"
    return {r["q"]: tuple(r["at"]) for r in falling.join(F.broadcast(wanted), "q").select("q", F.expr(walk).alias("at")).collect()}  # a row a query of the block


def thresholds(vectors: DataFrame, q_ids, q_mats, k: int, top: int, wide: bool):
    """For each query the k-th largest score, the largest id needed of that score, and how many rows of that id."""
    import numpy as np

    spark, n = vectors.sparkSession, len(q_ids)
    lowest, highest = -(2**63), 2**63 - 1
    value, last, copies = np.full(n, lowest, np.int64), np.full(n, highest, np.int64), np.full(n, highest, np.int64)
    need = np.full(n, k, np.int64)
    spread = vectors.agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).first()
    # scores, then ids of the scores that more rows have than are needed
    for first, size, phase in ((-top, 2 * top + 1, "score"), (~spread["b"], spread["b"] - spread["a"] + 1, "id")):
        if phase == "score":
            active = np.ones(n, bool)
        else:
            active = crowded
        if not active.any():
            break
        low, bits = np.full(n, first, np.int64), min(64, max(1, int(size - 1).bit_length()))
        crowded = np.zeros(n, bool)
        while True:
            shared = spark.sparkContext.broadcast((q_ids, q_mats, wide, low, bits, value if phase == "id" else None, active))
            got = _histogram(vectors, shared, {q: need[q] for q in np.flatnonzero(active)})
            shared.unpersist()
            step = max(0, bits - BITS)
            for q in np.flatnonzero(active):
                at, above, own = got.get(q, (-1, 0, 0))
                if at < 0:  # fewer than k candidates: all of them
                    active[q] = False
                    continue
                low[q] += at << step
                need[q] -= above
                crowded[q] = own > need[q]
            if not step or not active.any():
                break
            bits = step
        if phase == "score":
            value[active] = low[active]
        else:
            last[active], copies[active] = ~low[active], need[active]
    return value, last, copies


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each query; both inputs as from ``quantized``.

    ``block`` bounds the queries held at once; the number of passes over the candidates grows with the queries.
    """
    import numpy as np

    spark = vectors.sparkSession
    ship_package(spark)
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = materialize(vectors, "vectors")
    top = vectors.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + double(x) * double(x))")).alias("m")).first()["m"]
    if top is None:
        return spark.createDataFrame([], schema)
    if top >= 2.0**62.99:  # no inner product is larger than the largest square, by Cauchy and Schwarz
        raise ValueError("scores beyond 63 bits don't fit the result's column")
    top = int(top * (1 + 1e-9)) + 1
    wide = top >= 1 << 52
    wanted = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = wanted.count()
    blocks = max(1, -(-n // block))
    if blocks > 1:
        wanted = materialize(wanted.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries")
    parts = []
    for b in range(blocks):
        rows = (wanted.where(F.col("b") == b) if blocks > 1 else wanted).select("vec_id", "v").collect()  # about ``block`` rows
        if not rows:
            continue
        q_ids = np.array([r["vec_id"] for r in rows], np.int64)
        q_mats = {}
        for d in {len(r["v"]) for r in rows}:
            at = np.array([i for i, r in enumerate(rows) if len(r["v"]) == d])
            q_mats[d] = (at, np.array([rows[i]["v"] for i in at], np.int64))
        state = spark.sparkContext.broadcast((q_ids, q_mats, wide, *thresholds(vectors, q_ids, q_mats, k, top, wide)))

        def pick(batches, state=state):
            import numpy as np
            import pyarrow as pa

            q_ids, q_mats, wide, value, last, copies = state.value
            for at, ids, s, ok in _scored(batches, q_ids, q_mats, wide):
                v = value[at][:, None]
                row, col = np.nonzero(ok & ((s > v) | ((s == v) & (ids[None, :] <= last[at][:, None]))))
                q, score = at[row], s[row, col]
                most = np.where((score == value[q]) & (ids[col] == last[q]), copies[q], 2**63 - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[q], ids[col], score, most)], names=["query_id", "vec_id", "score", "most"])

        # rows that repeat an id and a score are counted, not listed, so that a query has k rows here at most
        near = vectors.mapInArrow(pick, "query_id long, vec_id long, score long, most long").groupBy("query_id", "vec_id", "score").agg(F.least(F.count("*"), F.min("most"), F.lit(k)).cast("int").alias("n"))
        listed = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "n"))).alias("best"))
        each = listed.select("query_id", F.explode("best").alias("x"), "best").select("query_id", "x", F.expr("aggregate(filter(best, y -> y < x), 0, (a, y) -> a + y.n)").alias("before"))
        ranked = each.select("query_id", F.explode(F.expr("sequence(before + 1, before + x.n)")).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
        parts.append(ranked if blocks == 1 else materialize(ranked, "topk"))
    if blocks > 1:
        discard(wanted), discard(vectors)
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
