"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows of an Arrow batch where the session has Spark's default of 10,000: whole texts are long
BATCH_ROWS = 2000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python finds it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_edgeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="edgeloom-")  # on the driver only; Spark serves the file to the executors
    archive = os.path.join(folder, "edgeloom_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(archive)
    sc._edgeloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where the session has none, a local session gets a folder
    of its own, as in tests; a cluster gets an error, since nothing local is shared there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        folder = sc.getCheckpointDir()
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="edgeloom-ckpt-"))
            folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/edgeloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._edgeloom_path = path
    return back


def discard(table: DataFrame) -> None:
    """Delete a materialized table that a later one has replaced."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._edgeloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: a key is hot from this many rows on, and from one in so many of all rows: so there are at most ``HOT_KEYS`` hot keys
HOT_ROWS, HOT_KEYS = 10_000, 20_000


def hot_from(total: int) -> int:
    return max(HOT_ROWS, total // HOT_KEYS)


def lookup(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in column ``n`` how many of the ``total`` rows of
    ``left`` have it. Rows of hot keys stay where they are and meet a broadcast of at most ``HOT_KEYS`` rows; the
    others are shuffled. ``right`` is read more than once."""
    least = hot_from(total)
    if total < least:
        return left.join(right, on, how)
    hot = right.where(F.col("n") >= least)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col("n") < least), on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def gives_back(run):
    """``run`` for mapInArrow: after a task's last batch its free memory goes back to the system. Python workers outlive
    their tasks, and what they hold for later counts beside the other worker and the JVM."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return wrapped


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lower_ascii(col):
    return F.translate(col, _UPPER, _LOWER)


def slices(batch, rows: int = 512, max_bytes: int = 8 << 20, text: int | None = None):
    """Cut an Arrow batch into small ones: at most ``rows`` rows, and about ``max_bytes`` of column ``text``."""
    n = batch.num_rows
    if text is None or n == 0:
        for i in range(0, n, rows):
            yield batch.slice(i, rows)
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    i = 0
    while i < n:
        j, total = i, 0
        while j < n and j - i < rows and (j == i or total + size[j] <= max_bytes):
            total += int(size[j])
            j += 1
        yield batch.slice(i, j - i)
        i = j


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int, text: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most ``limit`` labelled rows for fitting: those of the smallest hashes of doc_id, without
    held-out rows (crc32 of the id as text, modulo ``modulus``, equal to ``held_out``). Bounded by ``limit``."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", modulus) != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max(label).alias("y")).orderBy(F.xxhash64("k", F.lit(7)), "k").limit(limit)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # at most ``limit`` pairs of numbers
    got = rows.join(F.broadcast(known), "k").orderBy(F.xxhash64("k", F.lit(7)), "k", "t").limit(limit).collect()
    return [(r["t"], int(r["y"])) for r in got]


def remainder(col: str, modulus: int):
    """crc32 of a number's decimal text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus
