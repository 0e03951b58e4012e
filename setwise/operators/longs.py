"""Sets of unsigned 64-bit values, held as BIGINT (values from 2**63 up are negative).

Bounds and values are given as unsigned or as they are held. Unsigned ranges become one or two signed ones, so that they
reach the Parquet scan. Set algebra, cardinalities and predicates do not depend on order: those of `algebra` serve.

Ranks go down the four 16-bit digits of a value: a table of prefixes at each level, each from the one below, holds what
comes before a prefix within its parent. No window holds more than 65,536 rows, however values lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setwise.functions.integers import CHUNK, unsigned64_key

TOP = 1 << 64


def held(x: int) -> int:
    """An unsigned value as the BIGINT that holds it; held ones stay as they are."""
    if not -(1 << 63) <= x < TOP:
        raise ValueError("value beyond 64 bits")
    return x - TOP if x >= 1 << 63 else x


def _bounds(start: int, end: int) -> list[tuple[int, int]]:
    """[start, end) as signed ranges; empty, inverted and outside ranges raise ValueError."""
    start = start % TOP if start < 0 else start
    if not 0 <= start < end <= TOP:
        raise ValueError("empty or invalid range")
    half = 1 << 63
    parts = [(start, min(end, half)), (max(start, half) - TOP, end - TOP)]
    return [(a, b) for a, b in parts if a < b]


def within(v: Column, start: int, end: int) -> Column:
    """Whether v lies in [start, end)."""
    out = F.lit(False)
    for a, b in _bounds(start, end):
        out = out | v.between(a, b - 1)
    return out


def value_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    parts = [spark.range(a, b) if b < 1 << 63 else spark.range(a, b - 1).union(spark.range(1).select(F.lit(b - 1).alias("id"))) for a, b in _bounds(start, end)]
    out = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return out.select(F.col("id").alias("v"))


def add(a: DataFrame, x: int) -> DataFrame:
    return remove(a, x).unionByName(a.sparkSession.range(1).select(F.lit(held(x)).alias("v")))


def remove(a: DataFrame, x: int) -> DataFrame:
    return a.select("v").where(F.col("v") != held(x))


def flip(a: DataFrame, x: int) -> DataFrame:
    there = a.select("v").where(F.col("v") == held(x))
    gone = a.sparkSession.range(1).select(F.lit(held(x)).alias("v")).join(there, "v", "left_anti")
    return remove(a, x).unionByName(gone)


def contains(a: DataFrame, x: int) -> DataFrame:
    """One row: whether x is there."""
    return a.where(F.col("v") == held(x)).limit(1).agg((F.count("*") > 0).alias("contains"))


def select_range(a: DataFrame, start: int, end: int) -> DataFrame:
    """Values of [start, end); also the forward iterator from start, with end 2**64."""
    return a.where(within(F.col("v"), start, end))


def add_range(a: DataFrame, start: int, end: int) -> DataFrame:
    return a.select("v").where(~within(F.col("v"), start, end)).unionByName(value_range(a.sparkSession, start, end))


def remove_range(a: DataFrame, start: int, end: int) -> DataFrame:
    return a.where(~within(F.col("v"), start, end))


def flip_range(a: DataFrame, start: int, end: int) -> DataFrame:
    inside = value_range(a.sparkSession, start, end).join(select_range(a, start, end).select("v"), "v", "left_anti")
    return remove_range(a.select("v"), start, end).unionByName(inside)


def ends(a: DataFrame) -> DataFrame:
    """One row: first, last in unsigned order; null if there are none."""
    key = unsigned64_key(F.col("v"))
    return a.agg(F.min_by("v", key).alias("first"), F.max_by("v", key).alias("last"))


def cardinality(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("card"))


def int_cardinality(a: DataFrame) -> DataFrame:
    """One row: the cardinality as INT; an error from 2**31 up."""
    n = F.col("card")
    return cardinality(a).select(F.when(n >= 1 << 31, F.raise_error(F.lit("cardinality beyond 32 bits")).cast("int")).otherwise(n.cast("int")).alias("card"))


def _prefixes(dealt: DataFrame) -> DataFrame:
    """p48 (the high 48 bits of the order key), card, before (values below the prefix) of dealt rows."""
    level = dealt.groupBy("p48").agg(F.count("v").alias("card"))
    tables = []
    for low, high in (("p48", "p32"), ("p32", "p16"), ("p16", None)):
        parent = [] if high is None else [F.shiftright(low, 16).alias(high)]
        level = level.select(low, "card", *parent)
        own = W.partitionBy(*([high] if high else [])).orderBy(low).rowsBetween(W.unboundedPreceding, -1)
        tables.append(level.withColumn("before_" + low, F.coalesce(F.sum("card").over(own), F.lit(0))))
        if high:
            level = level.groupBy(high).agg(F.sum("card").alias("card"))
    out = tables[0].join(tables[1].drop("card"), "p32").join(tables[2].drop("card"), "p16")
    return out.select("p48", "card", (F.col("before_p48") + F.col("before_p32") + F.col("before_p16")).cast("long").alias("before"))


def _dealt(a: DataFrame) -> DataFrame:
    """v, p48: dealt by prefix once, for the prefixes' table as for the numbers within one."""
    return a.select("v", F.shiftright(unsigned64_key(F.col("v")), 16).alias("p48")).where("v is not null and p48 is not null").repartition("p48")


def _numbered(dealt: DataFrame) -> DataFrame:
    return dealt.withColumn("k", F.row_number().over(W.partitionBy("p48").orderBy(unsigned64_key(F.col("v")))))


def ranked(a: DataFrame) -> DataFrame:
    """v, rank: values at or below v in unsigned order, from 1."""
    dealt = _dealt(a)
    return _numbered(dealt).join(_prefixes(dealt).select("p48", "before"), "p48").select("v", (F.col("before") + F.col("k")).alias("rank"))


def rank_of(a: DataFrame, x: int) -> DataFrame:
    """One row: values at or below x."""
    return a.agg(F.count(F.when(unsigned64_key(F.col("v")) <= unsigned64_key(F.lit(held(x))), 1)).alias("rank"))


def page(a: DataFrame, first: int, size: int) -> DataFrame:
    """v, rank of the values of ranks first + 1 to first + size: only prefixes that reach into them are numbered."""
    dealt = _dealt(a)
    reach = _prefixes(dealt).where((F.col("before") < first + size) & (F.col("before") + F.col("card") > first)).select("p48", "before")
    rank = F.col("before") + F.col("k")
    return _numbered(dealt.join(reach, "p48")).withColumn("rank", rank).where((F.col("rank") > first) & (F.col("rank") <= first + size)).select("v", "rank")


def select(a: DataFrame, j: int) -> DataFrame:
    """The j-th smallest value, from 0; no row beyond the last."""
    return page(a, j, 1).select("v")


def limit(a: DataFrame, k: int) -> DataFrame:
    """The k smallest values."""
    return page(a, 0, k).select("v")


def last(a: DataFrame, k: int) -> DataFrame:
    """The k largest values, from the largest: the start of the reverse iterator. Spark keeps k rows a task."""
    return a.select("v").orderBy(unsigned64_key(F.col("v")).desc()).limit(k)


def presence_runs(a: DataFrame, start: int, end: int) -> DataFrame:
    """first, last (inclusive, as held), present: the stretches of [start, end) that are in the set, cut at multiples of 65,536, and those between them."""
    inside = select_range(a, start, end)
    key = unsigned64_key(F.col("v"))
    dealt = inside.select(key.alias("key"), F.shiftright(key, 16).alias("p48")).repartition("p48")
    island = F.col("key").bitwiseAND(CHUNK - 1) - F.row_number().over(W.partitionBy("p48").orderBy("key"))
    pieces = dealt.withColumn("island", island).groupBy("p48", "island").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # Of each prefix what begins and ends it; what follows a piece is the next one of its prefix or the next prefix's first.
    sides = pieces.groupBy("p48").agg(F.min("first").alias("low"), F.max("last").alias("high"))
    flat = lambda x: unsigned64_key(F.lit(held(x)))
    sides = sides.withColumns({"p32": F.shiftright("p48", 16), "p16": F.shiftright("p48", 32)})
    after = F.lead("low").over(W.partitionBy("p32").orderBy("p48"))
    far = sides.groupBy("p16", "p32").agg(F.min("low").alias("low"))
    far = far.withColumn("next32", F.lead("low").over(W.partitionBy("p16").orderBy("p32")))
    top = sides.groupBy("p16").agg(F.min("low").alias("low"))
    top = top.withColumn("next16", F.lead("low").over(W.orderBy("p16")))
    sides = sides.withColumn("next48", after).join(far.select("p32", "next32"), "p32").join(top.select("p16", "next16"), "p16")
    sides = sides.select("p48", F.coalesce("next48", "next32", "next16").alias("beyond"))
    own_next = F.lead("first").over(W.partitionBy("p48").orderBy("first"))
    rows = pieces.withColumn("next", own_next).join(sides, "p48").withColumn("next", F.coalesce("next", "beyond"))
    last_key = flat(end - 1)
    gap = F.when(F.col("next").isNull() & (F.col("last") < last_key), F.struct((F.col("last") + 1).alias("first"), last_key.alias("last"), F.lit(False).alias("present")))
    gap = gap.when(F.col("next") > F.col("last") + 1, F.struct((F.col("last") + 1).alias("first"), (F.col("next") - 1).alias("last"), F.lit(False).alias("present")))
    here = F.struct(F.col("first"), F.col("last"), F.lit(True).alias("present"))
    out = rows.select(F.explode(F.array_compact(F.array(here, gap))).alias("r")).select("r.*")
    first_key = flat(start)
    head = dealt.agg(F.min("key").alias("low")).where(F.col("low").isNull() | (F.col("low") > first_key))
    head = head.select(first_key.alias("first"), F.coalesce(F.col("low") - 1, last_key).alias("last"), F.lit(False).alias("present"))
    return out.unionByName(head).select(unsigned64_key(F.col("first")).alias("first"), unsigned64_key(F.col("last")).alias("last"), "present")
