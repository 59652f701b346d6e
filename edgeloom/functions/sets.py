"""Set expressions on ascending arrays of distinct numbers, and on bit-packed rows (set_id, base, state)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect(a, b) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def intersect_count(a, b) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def merge(a, b) -> Column:
    """All elements of two lists in order; equal ones stay."""
    return F.sort_array(F.concat(a, b))


def subtract(a, b) -> Column:
    return F.sort_array(F.array_except(a, b))


def union(a, b) -> Column:
    return F.sort_array(F.array_union(a, b))


def union_count(a, b) -> Column:
    return F.size(F.array_union(a, b)).cast("long")


def symmetric_difference(a, b) -> Column:
    return F.sort_array(F.array_except(F.array_union(a, b), F.array_intersect(a, b)))


def difference_count(a, b) -> Column:
    return F.size(F.array_except(a, b)).cast("long")


def jaccard(a, b) -> Column:
    """0 for two empty sets."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def is_subset(a, b) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_strict_subset(a, b) -> Column:
    return is_subset(a, b) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def is_equal(a, b) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def is_empty(a) -> Column:
    return F.size(a) == 0


def overlaps(a, b) -> Column:
    return F.arrays_overlap(a, b)


def flip(a, lo: int, hi: int) -> Column:
    """Elements of [lo, hi) change places with those missing there."""
    span = F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")) if hi > lo else F.array().cast("array<long>")
    inside = F.array_except(span, a)
    return F.sort_array(F.concat(inside, F.filter(a, lambda x: (x < lo) | (x >= hi))))


def rank(a, x) -> Column:
    """How many elements are at most x."""
    return F.size(F.filter(a, lambda e: e <= x)).cast("long")


def select(a, k) -> Column:
    """The element at place k (from 0) in ascending order; null past the end."""
    return F.try_element_at(F.sort_array(a), F.lit(k) + 1) if isinstance(k, int) else F.try_element_at(F.sort_array(a), k + 1)


def add(a, x) -> Column:
    return F.sort_array(F.array_distinct(F.array_append(a, x)))


def remove(a, x) -> Column:
    return F.array_remove(a, x)


def minimum(a) -> Column:
    return F.array_min(a)


def maximum(a) -> Column:
    return F.array_max(a)


def contains(a, x) -> Column:
    return F.array_contains(a, x)


def to_text(a) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("}"))


def lowest_bit(x) -> Column:
    """Place of the lowest set bit."""
    return F.bit_count(x.bitwiseAND(-x) - 1)


# bit-packed rows: ``pairs`` (a, b) names the sets that meet


def _meet(packed: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    left = pairs.join(packed.select(F.col("set_id").alias("a"), "base", F.col("state").alias("sa")), "a")
    right = packed.select(F.col("set_id").alias("b"), "base", F.col("state").alias("sb"))
    return left.join(right, ["b", "base"], how)


def packed_intersect(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, base, state without empty states."""
    return _meet(packed, pairs, "inner").select("a", "b", "base", F.col("sa").bitwiseAND(F.col("sb")).alias("state")).where("state <> 0")


def packed_intersect_count(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    met = _meet(packed, pairs, "inner").groupBy("a", "b").agg(F.sum(F.bit_count(F.col("sa").bitwiseAND(F.col("sb")))).alias("n"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def packed_subtract(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, base, state of a without b."""
    return _meet(packed, pairs, "left").select("a", "b", "base", F.col("sa").bitwiseAND(F.bitwise_not(F.coalesce("sb", F.lit(0).cast("long")))).alias("state")).where("state <> 0")


def packed_insert(packed: DataFrame, additions: DataFrame) -> DataFrame:
    """``additions`` (set_id, elem) put into packed sets."""
    bits = additions.select("set_id", F.shiftright("elem", 5).alias("base"), F.expr("shiftleft(1L, cast(elem & 31 as int))").alias("state"))
    return packed.unionByName(bits).groupBy("set_id", "base").agg(F.bit_or("state").alias("state"))


def bucketed_intersect(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, elem: met on the high 16 bits and the low ones of elements of rows (set_id, elem)."""
    cut = sets.select("set_id", F.shiftright("elem", 16).alias("hi"), F.col("elem").bitwiseAND(0xFFFF).alias("lo"))
    left = pairs.join(cut.select(F.col("set_id").alias("a"), "hi", "lo"), "a")
    met = left.join(cut.select(F.col("set_id").alias("b"), "hi", "lo"), ["b", "hi", "lo"])
    return met.select("a", "b", (F.shiftleft("hi", 16) + F.col("lo")).alias("elem"))


def bitmaps(sets: DataFrame) -> DataFrame:
    """set_id, bucket, bits: Spark's bitmap aggregates; their positions count from 1, so elements are shifted."""
    e = F.col("elem") + 1
    return sets.select("set_id", F.bitmap_bucket_number(e).alias("bucket"), F.bitmap_bit_position(e).alias("at")).groupBy("set_id", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def bitmap_cardinality(maps: DataFrame) -> DataFrame:
    return maps.groupBy("set_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def bitmap_union(maps: DataFrame) -> DataFrame:
    """bucket, bits of the union of all sets."""
    return maps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersect_count(maps: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, n: common elements of two bitmaps."""
    named = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("set_id")).join(maps, "set_id")
    both = named.groupBy("a", "b", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("c")).where("c = 2")
    met = both.groupBy("a", "b").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def odd_members(sets: DataFrame) -> DataFrame:
    """elem: in an odd number of the sets (their many-way symmetric difference)."""
    return sets.groupBy("elem").agg(F.count("*").alias("c")).where("c % 2 = 1").select("elem")
