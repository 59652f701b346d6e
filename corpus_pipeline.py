"""Corpus pipeline: toxicity, quality, repeated lines, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of ``documents``. An empty table
gives an empty table at every stage; columns beyond those of ``documents`` stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import line_dedup, packing, quality, simhash, toxicity
from edgeloom.llm.common import materialize, read_table
from edgeloom.llm.tokens import default_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject, with repeated rows and null ids.

    A null or empty text is scored as an empty window. Without labels of both kinds all documents stay.
    """
    model = toxicity.fit_tables(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good, with repeated rows and null ids.

    A null or empty text is scored as an empty line. Without labels of both kinds all documents stay.
    """
    model = quality.fit_tables(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages that an earlier document holds are cut from the later ones.

    A null text stays null; a document without an id stays whole; one that loses all its lines stays with an empty text.
    """
    return line_dedup.dedup_lines(docs, n_chars="n_chars")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    A document without an id stays. Rows that repeat an id stay or go together. Null and empty texts are one group.
    """
    groups = simhash.near_duplicate_groups(docs, shingle=5, similarity=0.8)
    gone = groups.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece of a document.

    A null text is empty and takes its end token; rows with repeated or null ids are packed each on their own.
    """
    return packing.pack_documents(docs, tokenizer=default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("line_dedup", cut_repeated_lines),
    ("simhash_dedup", one_of_near_copies),
    ("packing", pack_sequences),
]

#: model scores, alignments and packings have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
