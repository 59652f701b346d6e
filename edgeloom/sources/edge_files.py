"""Edge-list files: 8-byte binary records and text, id maps, labels and patterns.

Binary records hold two unsigned 32-bit numbers, little-endian. ``src_first`` stores the source in the first four
bytes, ``hi_first`` (a packed 64-bit number with the source in its high half) in the last four.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RECORD = 8


#: bytes of a file that one task reads, and that one batch holds
SPLIT, BATCH = 64 << 20, 4 << 20


def _store(path: str):
    """(file system, path on it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: without one Spark's default file system is meant, on every machine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def read_binary_edges(spark: SparkSession, path: str, word_order: str = "src_first") -> DataFrame:
    """src, dst of each record. Files are split at record borders; a length that is no multiple of 8 is an error."""
    if word_order not in ("src_first", "hi_first"):
        raise ValueError("word_order is src_first or hi_first")
    bad = spark.read.format("binaryFile").load(path).select("length").where(F.col("length") % RECORD != 0)
    if not bad.isEmpty():
        raise ValueError(f"{path}: a file's length is no multiple of {RECORD}")
    spark.dataSource.register(EdgeFiles)
    return spark.read.format("edgebin").option("word_order", word_order).load(qualified(spark, path))


class _Range(InputPartition):
    def __init__(self, name: str, lo: int, hi: int):
        self.name, self.lo, self.hi = name, lo, hi


class _EdgeReader(DataSourceReader):
    """Byte ranges of all files under a path, whole records each, as Arrow batches."""

    def __init__(self, path: str, order: str):
        self.path, self.order = path, order

    def partitions(self):
        from pyarrow import fs

        store, base = _store(self.path)
        top = store.get_file_info(base)
        files = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base))
        files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return [_Range(name, lo, min(size, lo + SPLIT)) for name, size in files for lo in range(0, size, SPLIT)] or [_Range("", 0, 0)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        if partition.lo == partition.hi:
            return
        a, b = (0, 1) if self.order == "src_first" else (1, 0)
        with _store(self.path)[0].open_input_file(partition.name) as f:
            f.seek(partition.lo)
            for at in range(partition.lo, partition.hi, BATCH):
                words = np.frombuffer(f.read(min(BATCH, partition.hi - at)), "<u4").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words[:, a].copy()), pa.array(words[:, b].copy())], names=["src", "dst"])


@dataclass
class _Part(WriterCommitMessage):
    name: str


class _EdgeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, order: str):
        self.path, self.order = path, order

    def _fs(self):
        return _store(self.path)

    def write(self, batches):
        import numpy as np
        from pyspark import TaskContext

        context, (store, base) = TaskContext.get(), self._fs()
        store.create_dir(base)
        name = f"{base}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        with store.open_output_stream(name) as f:
            for batch in batches:
                s, d = (batch.column(i).to_numpy() for i in (0, 1))
                if len(s) and (min(s.min(), d.min()) < 0 or max(s.max(), d.max()) >> 32):
                    raise ValueError("binary records hold ids from 0 to 2**32 - 1")
                s, d = s.astype("<u4"), d.astype("<u4")
                f.write(np.stack([s, d] if self.order == "src_first" else [d, s], 1).tobytes())
        return _Part(name)

    def commit(self, messages):
        store, base = self._fs()
        for i, m in enumerate(messages):
            if m is not None:
                store.move(m.name, f"{base}/part-{i:05d}.bin")

    def abort(self, messages):
        store, _ = self._fs()
        for m in messages:
            if m is not None:
                store.delete_file(m.name)


class EdgeFiles(DataSource):
    """Source and sink ``edgebin``: options path and word_order; parts appear under their final names on commit only."""

    @classmethod
    def name(cls):
        return "edgebin"

    def schema(self):
        return "src long, dst long"

    def reader(self, schema):
        return _EdgeReader(self.options["path"], self.options.get("word_order", "src_first"))

    def writer(self, schema, overwrite):
        return _EdgeWriter(self.options["path"], self.options.get("word_order", "src_first"))


def write_binary_edges(edges: DataFrame, path: str, word_order: str = "src_first") -> None:
    edges.sparkSession.dataSource.register(EdgeFiles)
    edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).write.format("edgebin").option("word_order", word_order).mode("append").save(qualified(edges.sparkSession, path))


def _two_numbers(spark, path, comments: bool):
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    if comments:
        rows = rows.where(~F.col("value").startswith("#"))
    parts = F.split("value", r"\s+")
    return rows.select(parts[0].cast("long").alias("a"), parts[1].cast("long").alias("b"))


def read_text_edges(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    return _two_numbers(spark, path, comments).toDF("src", "dst")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``old new`` lines; lines that start with # are comments."""
    return _two_numbers(spark, path, True).toDF("old_id", "new_id")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label of vertex i stands in line i, as the second number."""
    lines = spark.read.text(path).rdd.map(lambda r: r[0]).zipWithIndex()  # line numbers have no DataFrame form
    rows = spark.createDataFrame(lines, "line string, v long").where(F.trim("line") != "")
    return rows.select("v", F.split(F.trim("line"), r"\s+")[1].cast("int").alias("label"))


def write_text_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)


def write_id_map(relabel: DataFrame, path: str) -> None:
    relabel.orderBy("old_id").select(F.concat_ws(" ", "old_id", "new_id").alias("value")).write.text(path)


def write_cliques(cliques: DataFrame, path: str) -> None:
    """One clique a line."""
    cliques.select(F.array_join(F.col("members").cast("array<string>"), " ").alias("value")).write.text(path)


def write_match_counts(counts: DataFrame, path: str) -> None:
    """``ans<i>=<count>`` lines."""
    counts.select(F.concat(F.lit("ans"), F.col("query_id").cast("string"), F.lit("="), F.col("n").cast("string")).alias("value")).write.text(path)


def text_to_binary(spark: SparkSession, source: str, target: str, word_order: str = "src_first") -> None:
    write_binary_edges(read_text_edges(spark, source), target, word_order)


def binary_to_text(spark: SparkSession, source: str, target: str, word_order: str = "src_first") -> None:
    write_text_edges(read_binary_edges(spark, source, word_order), target)


def power_law_edges(spark: SparkSession, vertices: int, alpha: float, beta: float, seed: int = 0) -> DataFrame:
    """A random graph whose i-th vertex has beta * (i + 1) ** -alpha outgoing edges, rounded down, to random ends."""
    rows = spark.range(vertices).select(F.col("id").alias("src"), F.floor(beta * F.pow(F.col("id") + 1, F.lit(-alpha))).alias("k")).where("k > 0")
    ends = rows.select("src", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("i"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", "src", "i", F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return ends.select("src", (draw % vertices).alias("dst"))


def random_set_pair(spark: SparkSession, length: int, skew: float = 1.0, selectivity: float = 0.1, density: float = 0.01, seed: int = 0) -> DataFrame:
    """set_id a and b: ``length`` and length / skew distinct numbers, length * selectivity of them in both, spread so
    that the union fills ``density`` of its range."""
    other = max(1, int(length / skew))
    common = min(int(length * selectivity), other)
    union = length + other - common
    step = max(1, int(1 / density))
    rows = spark.range(union).select((F.col("id") * step + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(step))).alias("elem"), F.xxhash64("id", F.lit(seed + 1)).alias("h"))
    from ..plans.storage import global_rank

    ranked = global_rank(rows, "h", "elem")
    in_a, in_b = F.col("rank") < length, F.col("rank") >= length - common
    return ranked.select(F.explode(F.array_compact(F.array(F.when(in_a, F.lit("a")), F.when(in_b, F.lit("b"))))).alias("set_id"), "elem")
