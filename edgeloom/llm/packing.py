"""Best-fit packing with certified bounds.

Pieces are dealt over groups; each group runs best-fit decreasing and compares its number of sequences with a
lower bound from dual feasible functions. Groups that are certified keep their full sequences. Open sequences of
groups with a gap, and the partly filled rest of certified ones, are dissolved; their pieces are exchanged over
fewer groups and packed again, until the whole count meets the whole bound, the pool fits one group, or an exchange
saved less than ``SAVING`` of the sequences that it dissolved. ``certificate`` tells how far the result is proven best.

Defined cases: null or empty text is an empty text and takes its end token alone; rows with a repeated or null
doc_id are packed each on their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import gives_back, materialize, ship_package, slices

CAPACITY = 1024
GROUP_PIECES = 16_384
#: an exchange that saves a smaller share of the sequences it dissolved is the last
SAVING = 0.001


def lower_bound(counts, capacity: int) -> int:
    """Least number of bins for ``counts[s]`` items of size ``s``: the best of the volume bound and two families of
    dual feasible functions (threshold, and rounding to k+1 parts)."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    sizes = np.arange(len(counts), dtype=np.int64)
    volume = int((counts * sizes).sum())
    best = -(-volume // capacity)
    n_from = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    v_from = np.concatenate([np.cumsum((counts * sizes)[::-1])[::-1], [0]])
    for t in range(1, capacity // 2 + 1):  # above capacity - t: a bin each; below t: nothing
        big = int(n_from[min(capacity - t + 1, len(counts))])
        mid = int(v_from[min(t, len(counts))] - v_from[min(capacity - t + 1, len(counts))])
        best = max(best, big + -(-mid // capacity))
    for k in range(1, 21):  # x(k+1) whole: x stays, else floor((k+1)x)/k
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths, capacity: int):
    """(bin number, offset in the bin) of each length, by best fit on lengths in falling order."""
    import numpy as np

    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # bit r of mask: some bin has r places left
    for i, s in zip(order.tolist(), np.asarray(lengths)[order].tolist()):
        above = mask >> s
        if above:
            room = s + ((above & -above).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - s
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offsets


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Tokenise and cut: one row per piece with its start, length and the crc32 of its ids."""
    path = tokenizer or tokens.default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        end = np.array([tokens.END_ID], np.uint32).tobytes()
        for batch in batches:
            for part in slices(batch, max_bytes=2 << 20, text=1):
                rows = []
                for d, data in zip(part.column(0).to_pylist(), tokens.token_bytes([t or "" for t in part.column(1).to_pylist()], path)):
                    data += end
                    n = len(data) // 4
                    at, k = 0, 0
                    first = n % capacity or capacity if n > capacity else n
                    while at < n:
                        size = first if k == 0 else capacity
                        rows.append((d, k, at, size, tokens.crc32(data[4 * at : 4 * (at + size)])))
                        at += size
                        k += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship_package(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(gives_back(cut), schema)


def _pack_round(rows: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Best-fit decreasing in each group; bins of level ``level`` that stay have ``open`` false."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, bins long, left long, head boolean"

    def pack(table):
        import numpy as np
        import pyarrow as pa

        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-(2**63)).to_numpy(), -lengths))
        table = table.take(pa.array(order))
        lengths = lengths[order]
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if n > bound:
            opened = fill < capacity
        else:  # certified: only the emptiest bin can still gain from the exchange
            opened = (fill < capacity) & (np.arange(n) == fill.argmin())
        g = int(table.column("g")[0].as_py())
        head = np.zeros(len(bins), bool)
        head[0] = True
        return pa.table(
            {c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            | {"sequence_id": (np.int64(level) << 58) + (np.int64(g) << 24) + bins, "offset": offsets, "open": opened[bins], "bins": np.full(len(bins), n), "left": np.full(len(bins), opened.sum()), "head": head}
        )

    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)  # nothing else parts equal texts without ids
    keyed = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level), apart), F.lit(groups)))
    return keyed.groupBy("g").applyInArrow(pack, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place ``pieces`` rows into sequences. ``group_pieces`` bounds what one task holds."""
    base = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = base + ["sequence_id", "offset"]
    rows = rows.select(base)
    full = rows.where(F.col("length") == capacity)
    pool = rows.where(F.col("length") < capacity)
    placed = [full.select(*base, (F.lit(-(2**62)) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    size, level, dissolved = pool.count(), 0, None
    while size:
        groups = -(-size // group_pieces)
        done = materialize(_pack_round(pool, groups, level, capacity), f"pack{level}")
        of_groups = lambda c: F.sum(F.when(F.col("head"), F.col(c)))
        stats = done.agg(of_groups("bins").alias("bins"), of_groups("left").alias("left"), F.sum(F.col("open").cast("long")).alias("open")).first()
        last = groups == 1 or not stats["open"] or stats["bins"] <= lower_bound(_length_counts(done, capacity), capacity)
        last = last or (dissolved is not None and dissolved - stats["bins"] < SAVING * dissolved)
        placed.append((done if last else done.where(~F.col("open"))).select(out))
        if last:
            break
        pool, size, dissolved = done.where("open").select(base), stats["open"], stats["left"]
        level += 1
    result = placed[0]
    for p in placed[1:]:
        result = result.unionByName(p)
    return result


def _length_counts(rows: DataFrame, capacity: int) -> list[int]:
    counts = [0] * (capacity + 1)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    return counts


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int | bool]:
    """sequences, the lower bound of all pieces together, and whether the two are equal: then no packing has fewer."""
    bound = lower_bound(_length_counts(packed, capacity), capacity)
    n = packed.agg(F.count_distinct("sequence_id")).first()[0]
    return {"sequences": n, "bound": bound, "certified": n == bound}


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Only documents longer than ``capacity`` are cut; all their pieces but the first are full.
    """
    cut = materialize(pieces(docs, text, doc_id, capacity, tokenizer), "pieces")
    return pack(cut, capacity, group_pieces)
