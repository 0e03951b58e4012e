"""Set algebra over relations (set_id, v) and single sets (v): construction, mutation, predicates, pairwise and wide
operations, cardinalities. Sets hold distinct unsigned 32-bit values as BIGINT; every function returns a new relation.

Plans: pairwise operations are semi and anti joins or one aggregate on v; wide ones are one hash aggregate on v with
map-side partials, whatever the number of sets. Range restrictions are filters, which reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setwise.functions.integers import UNIVERSE


def make(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct values, from input in any order and with repeats."""
    return df.select(*cols).distinct()


def between(v: Column, start: int, end: int) -> Column:
    return (v >= start) & (v < end)


def value_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """[start, end); empty if start >= end. Bounds outside the universe raise ValueError."""
    if not (0 <= start < UNIVERSE and 0 <= end <= UNIVERSE):
        raise ValueError("range outside [0, 2**32]")
    return spark.range(start, max(start, end)).select(F.col("id").alias("v"))


def shift(sets: DataFrame, offset: int) -> DataFrame:
    """Every value plus offset; values that leave the universe go."""
    return sets.withColumn("v", F.col("v") + offset).where(between(F.col("v"), 0, UNIVERSE))


def select_range(sets: DataFrame, start: int, end: int) -> DataFrame:
    return sets.where(between(F.col("v"), start, end))


def add_range(a: DataFrame, start: int, end: int) -> DataFrame:
    return a.select("v").where(~between(F.col("v"), start, end)).unionByName(value_range(a.sparkSession, start, end))


def remove_range(sets: DataFrame, start: int, end: int) -> DataFrame:
    return sets.where(~between(F.col("v"), start, end))


def flip_range(a: DataFrame, start: int, end: int) -> DataFrame:
    inside = value_range(a.sparkSession, start, end).join(select_range(a, start, end), "v", "left_anti")
    return remove_range(a.select("v"), start, end).unionByName(inside)


def add(a: DataFrame, x: int) -> DataFrame:
    return add_range(a, x, x + 1)


def remove(a: DataFrame, x: int) -> DataFrame:
    return a.where(F.col("v") != x)


def flip(a: DataFrame, x: int) -> DataFrame:
    return flip_range(a, x, x + 1)


def checked_add(a: DataFrame, delta: DataFrame) -> DataFrame:
    """v, changed for each value of delta: whether it was absent before."""
    return delta.select("v").distinct().join(a.select("v").withColumn("had", F.lit(True)), "v", "left").select("v", F.col("had").isNull().alias("changed"))


def checked_remove(a: DataFrame, delta: DataFrame) -> DataFrame:
    return checked_add(a, delta).withColumn("changed", ~F.col("changed"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("v"), "v", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").unionByName(b.select("v")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("v"), "v", "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return wide_xor(a.select("v").unionByName(b.select("v")))


def or_not(a: DataFrame, b: DataFrame, end: int) -> DataFrame:
    """a, and what b lacks of [0, end)."""
    inside = value_range(a.sparkSession, 0, end)
    kept = inside.join(difference(select_range(b, 0, end), a).select("v"), "v", "left_anti")
    return kept.unionByName(a.select("v").where(F.col("v") >= end))


def n_sets(sets: DataFrame) -> Column:
    """How many sets have a value: a scalar subquery, counted when the plan runs."""
    return set_ids(sets).agg(F.count("*")).scalar()


def wide_and(sets: DataFrame, n: int | Column | None = None) -> DataFrame:
    """Values of all n sets (empty ones count, though the relation has no rows of them; by default those that have values); none if there are no sets."""
    n = n_sets(sets) if n is None else F.lit(n)
    return sets.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") == n).select("v")


def wide_or(sets: DataFrame) -> DataFrame:
    return sets.select("v").distinct()


def wide_xor(sets: DataFrame) -> DataFrame:
    """Values in an odd number of sets."""
    return sets.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select("v")


def set_ids(sets: DataFrame) -> DataFrame:
    return sets.select("set_id").distinct()


def cardinalities(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of and_card, or_card, xor_card, andnot_card, from one aggregate over both."""
    both = a.select("v", F.lit(1).alias("side")).unionByName(b.select("v", F.lit(2).alias("side")))
    side = both.groupBy("v").agg(F.sum("side").alias("s"))
    count = lambda c: F.count(F.when(c, 1))
    s = F.col("s")
    return side.agg(count(s == 3).alias("and_card"), F.count("*").alias("or_card"), count(s != 3).alias("xor_card"), count(s == 1).alias("andnot_card"))


def pair_matrix(sets: DataFrame) -> DataFrame:
    """a, b, common, card_a, card_b for all pairs a < b of sets with a common value. Each value pairs the sets it is in: for few sets of many values."""
    left, right = sets.select("v", F.col("set_id").alias("a")), sets.select("v", F.col("set_id").alias("b"))
    common = left.join(right, "v").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    cards = sets.groupBy("set_id").agg(F.count("*").alias("card"))
    common = common.join(cards.select(F.col("set_id").alias("a"), F.col("card").alias("card_a")), "a")
    return common.join(cards.select(F.col("set_id").alias("b"), F.col("card").alias("card_b")), "b")


def pair_measures(sets: DataFrame, tolerance: int) -> DataFrame:
    """pair_matrix with hamming, similar (within tolerance; never if it is negative), a_holds_b, b_holds_a, jaccard."""
    m = pair_matrix(sets).withColumn("hamming", F.col("card_a") + F.col("card_b") - 2 * F.col("common"))
    return m.select("a", "b", "hamming", (F.col("hamming") <= tolerance).alias("similar"), (F.col("common") == F.col("card_b")).alias("a_holds_b"), (F.col("common") == F.col("card_a")).alias("b_holds_a"), (F.col("common") / (F.col("card_a") + F.col("card_b") - F.col("common"))).alias("jaccard"))


def consecutive_pairs(sets: DataFrame) -> DataFrame:
    """a, b, and_card, or_card, xor_card, andnot_card for neighbours in the order of set_id: one aggregate, each set on both sides. Only the names of sets are ordered as a whole."""
    order = W.orderBy("set_id")
    names = set_ids(sets).select("set_id", F.lag("set_id").over(order).alias("left"), F.lead("set_id").over(order).alias("right"))
    own = F.col("set_id")
    sides = F.filter(F.array(F.struct(own.alias("a"), F.col("right").alias("b"), F.lit(1).alias("side")), F.struct(F.col("left").alias("a"), own.alias("b"), F.lit(2).alias("side"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    near = sets.join(names, "set_id").select("v", F.explode(sides).alias("p"))
    side = near.groupBy("p.a", "p.b", "v").agg(F.sum("p.side").alias("s"))
    count = lambda c: F.count(F.when(c, 1))
    s = F.col("s")
    return side.groupBy("a", "b").agg(count(s == 3).alias("and_card"), F.count("*").alias("or_card"), count(s != 3).alias("xor_card"), count(s == 1).alias("andnot_card"))


def contains_range(a: DataFrame, start: int, end: int) -> DataFrame:
    """One row: whether all of [start, end) is there; false for an empty range."""
    return select_range(a, start, end).agg(((F.count("*") == max(0, end - start)) & F.lit(end > start)).alias("contains"))


def intersects_range(a: DataFrame, start: int, end: int) -> DataFrame:
    return select_range(a, start, end).limit(1).agg((F.count("*") > 0).alias("intersects"))


def contains_set(a: DataFrame, subset: DataFrame) -> DataFrame:
    """One row: whether subset (true if empty) is in a."""
    return difference(subset, a).limit(1).agg((F.count("*") == 0).alias("contains"))


def intersects(a: DataFrame, b: DataFrame) -> DataFrame:
    return intersection(a, b).limit(1).agg((F.count("*") > 0).alias("intersects"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    return symmetric_difference(a, b).limit(1).agg((F.count("*") == 0).alias("equal"))


def exceeds(a: DataFrame, threshold: int) -> DataFrame:
    """One row: whether a has over threshold values; each task counts its own."""
    return a.agg((F.count("*") > threshold).alias("exceeds"))


def clear(a: DataFrame) -> DataFrame:
    return a.limit(0)


def is_empty(a: DataFrame) -> DataFrame:
    """One row: whether a has no value."""
    return a.limit(1).agg((F.count("*") == 0).alias("empty"))


def fingerprints(sets: DataFrame) -> DataFrame:
    """set_id, card, mark: equal sets have equal card and mark, whatever the order of rows; different ones by chance of 2**-64 only."""
    return sets.groupBy("set_id").agg(F.count("*").alias("card"), F.bit_xor(F.xxhash64("v")).alias("mark"))


def equal_sets(sets: DataFrame) -> DataFrame:
    """set_id, first: the smallest name among the sets that equal each set, by fingerprints: no set is compared with another."""
    f = fingerprints(sets)
    return f.withColumn("first", F.min("set_id").over(W.partitionBy("card", "mark"))).select("set_id", "first")


def rollup_cardinality(sets: DataFrame, *dims: str) -> DataFrame:
    """Distinct values at every level of dims."""
    return sets.rollup(*dims).agg(F.countDistinct("v").alias("card"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    """Sets as one relation, with their place in the list as set_id."""
    return reduce(DataFrame.unionByName, [p.select(F.lit(k).alias("set_id"), "v") for k, p in enumerate(parts)])
