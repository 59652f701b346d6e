"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts (with the id as the second key, so that a huge group of
copies spreads over many partitions), an external sort places equal texts next to each other, and neighbours are
compared in full. Runs that touch a partition's edge are joined by their whole text in a second, tiny step.

Splitters are short: the first characters, a hash of the whole text and the id, so what the driver samples stays
small however long the texts are. Equal texts agree in the first two, and the sort goes on to the whole text.

Defined cases: null text counts as empty; texts are equal when identical after lower-casing A-Z only; a null id
loses against any other; rows that repeat both text and id count each, and one of them stays; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, ship_package, shuffle_width


#: characters of a text that take part in splitters
HEAD = 24


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``keep`` is smallest or largest."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    ship_package(spark)
    largest = keep == "largest"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    rows = rows.withColumns({"head": F.substring("norm", 1, HEAD), "hash": F.xxhash64("norm")})
    # the id that stays comes last in its run
    own = F.col("doc_id").asc_nulls_first() if largest else F.col("doc_id").desc_nulls_first()
    ranged = rows.repartitionByRange(partitions or shuffle_width(spark), "head", "hash", own).sortWithinPartitions("head", "hash", "norm", own)
    ranged = ranged.select("doc_id", "norm", "hash")
    schema = "doc_id long, sha binary, last boolean, keep_id long, group_size long, part int, run long, edge boolean, norm string"

    def scan(batches):
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
        names = ["doc_id", "sha", "last", "keep_id", "group_size", "part", "run", "edge", "norm"]

        def of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

        def flush(ids, sha, run, edge, norm):
            keep_id, n = ids[-1], len(ids)
            known = (None, None) if edge else (keep_id, n)
            for i in range(0, n, 20_000):
                yield of([(d, sha, i + j == n - 1, *known, part, run, edge, None) for j, d in enumerate(ids[i : i + 20_000])])
            if edge:  # what the run is, with its whole text
                yield of([(keep_id, None, None, keep_id, n, part, run, True, norm)])

        def close(runs, edge):
            """The runs of one key: one, but for texts whose hashes collide."""
            for run, ids, norm in runs:
                sha = hashlib.sha256(norm.encode("utf-8", "surrogatepass")).digest()
                if edge or len(ids) > 1000:
                    yield from flush(ids, sha, run, edge, norm)
                else:
                    n, k = len(ids), ids[-1]
                    rows.extend((x, sha, j == n - 1, k, n, part, run, False, None) for j, x in enumerate(ids))

        before, key, first, runs, run, rows = None, None, None, [], 0, []
        for batch in batches:
            for d, norm, hashed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if hashed == key and norm == before:
                    runs[-1][1].append(d)
                    continue
                now = (norm[:HEAD], hashed)
                if runs and now != (before[:HEAD], key):
                    if first is None:
                        first = (before[:HEAD], key)
                    yield from close(runs, (before[:HEAD], key) == first)
                    runs = []
                    if len(rows) >= 10_000:
                        yield of(rows)
                        rows.clear()
                runs.append((run, [d], norm))
                run += 1
                before, key = norm, hashed
        yield from close(runs, True)
        if rows:
            yield of(rows)

    found = materialize(ranged.mapInArrow(scan, schema), "runs")
    # two rows a partition at most; equal whole texts meet here
    pick = F.max("keep_id") if largest else F.min("keep_id")
    whole = (
        found.where("norm is not null").groupBy("norm").agg(pick.alias("whole_keep"), F.sum("group_size").alias("whole_size"), F.collect_list(F.struct("part", "run")).alias("at"))
        .select("whole_keep", "whole_size", F.explode("at").alias("at")).select(F.col("at.part").alias("part"), F.col("at.run").alias("run"), "whole_keep", "whole_size")
    )
    # ``whole`` has at most two rows of four numbers a partition
    joined = found.where("norm is null").join(F.broadcast(whole), ["part", "run"], "left")
    keep_id = F.when(F.col("edge"), F.col("whole_keep")).otherwise(F.col("keep_id"))
    own = F.col("last") & F.col("doc_id").eqNullSafe(keep_id)
    return joined.select("doc_id", keep_id.alias("keep_id"), F.when(F.col("edge"), F.col("whole_size")).otherwise(F.col("group_size")).alias("group_size"), own.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names. Needs distinct ids."""
    stay = exact_dedup(docs, text, doc_id, keep).where("kept").select(F.col("doc_id").alias("stay"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("stay")), "left_semi").select("row.*")
