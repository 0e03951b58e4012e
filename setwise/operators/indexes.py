"""Range index (rid, val) and bit-sliced index (col_id, val): predicates, aggregates and element-wise operations.

Both are plain columns: a predicate is a filter that reaches the Parquet scan, a context or found set is a semi join.
Slices are derived where an algorithm over them is wanted, and give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.functions.integers import unsigned64_key

#: Slices that a descent decides in a pass.
DIGIT = 12

OPS = {"lt": lambda v, t: v < t, "lte": lambda v, t: v <= t, "gt": lambda v, t: v > t, "gte": lambda v, t: v >= t, "eq": lambda v, t: v == t, "neq": lambda v, t: v != t}


def bits_needed(largest: int) -> int:
    """Slices for values up to largest."""
    return max(1, largest.bit_length())


def check_domain(index: DataFrame, largest: int, column: str = "val") -> DataFrame:
    """index, where a negative value or one beyond the slices for largest raises an error when it is read."""
    bad = (F.col(column) < 0) | (F.col(column) > (1 << bits_needed(largest)) - 1)
    return index.withColumn(column, F.when(bad, F.raise_error(F.lit("value too large or negative")).cast("long")).otherwise(F.col(column)))


def compare(index: DataFrame, op: str, threshold: int, context: DataFrame | None = None, key: str = "rid") -> DataFrame:
    """Ids whose value compares so; restricted to the ids of context, if given. Ids without a value never match."""
    out = index.where(OPS[op](F.col("val"), threshold)).select(key)
    return out.join(context.select(key), key, "left_semi") if context is not None else out


def compare_unsigned(index: DataFrame, op: str, threshold: int, context: DataFrame | None = None, key: str = "rid") -> DataFrame:
    """As compare, over unsigned 64-bit values held as BIGINT."""
    out = index.where(OPS[op](unsigned64_key(F.col("val")), unsigned64_key(F.lit(threshold).cast("long")))).select(key)
    return out.join(context.select(key), key, "left_semi") if context is not None else out


def dense(index: DataFrame, key: str = "rid") -> DataFrame:
    """One row: whether the ids are 0 to n - 1, each once, as appending gives them."""
    one = index.agg(F.count(key).alias("n"), F.countDistinct(key).alias("d"), F.min(key).alias("low"), F.max(key).alias("high"))
    return one.select(((F.col("n") == 0) | ((F.col("n") == F.col("d")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))).alias("dense"))


def within(index: DataFrame, found: DataFrame | None, key: str = "col_id") -> DataFrame:
    """index restricted to the ids of found; all of it without one."""
    return index if found is None else index.join(found.select(key), key, "left_semi")


def between(index: DataFrame, low: int, high: int, context: DataFrame | None = None, key: str = "rid") -> DataFrame:
    """Ids with low <= val <= high; none if low > high."""
    out = index.where(F.col("val").between(low, high)).select(key)
    return out.join(context.select(key), key, "left_semi") if context is not None else out


def is_in(index: DataFrame, values: DataFrame, found: DataFrame | None = None, key: str = "col_id") -> DataFrame:
    """Ids (of found) whose value is one of values (val)."""
    return within(index, found, key).join(values.select("val").distinct(), "val", "left_semi").select(key)


def total(index: DataFrame, found: DataFrame) -> DataFrame:
    """One row: sum of the values of found, and the size of found, ids without a value included."""
    return found.select("col_id").join(index, "col_id", "left").agg(F.coalesce(F.sum("val"), F.lit(0)).alias("total"), F.count("*").alias("n"))


def top_k(index: DataFrame, k: int, found: DataFrame | None = None) -> DataFrame:
    """Ids (of found) of the k largest values; among equal values the smallest ids go first. All ids with a value if k is larger; a negative k raises ValueError. Spark keeps k rows a task."""
    if k < 0:
        raise ValueError("k is negative")
    return within(index, found).orderBy(F.desc("val"), F.desc("col_id")).limit(k).select("col_id")


def pairs(index: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """col_id, val of the ids (of found) that have a value."""
    return within(index, found).where("val is not null").select("col_id", "val")


def transpose(index: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """val, n: how many ids (of found) have each value."""
    return within(index, found).groupBy("val").agg(F.count("*").alias("n"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise sum; a missing value counts as 0."""
    return a.unionByName(b).groupBy("col_id").agg(F.sum("val").alias("val"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both together; an id of both raises an error when it is read."""
    one = a.unionByName(b).groupBy("col_id").agg(F.max("val").alias("val"), F.count("*").alias("n"))
    return one.select("col_id", F.when(F.col("n") > 1, F.raise_error(F.lit("ids are not disjoint")).cast("long")).otherwise(F.col("val")).alias("val"))


def upsert(index: DataFrame, changes: DataFrame) -> DataFrame:
    """index (col_id, val) after changes (col_id, val, seq): the last one of an id holds. One aggregate, no window."""
    both = index.withColumn("seq", F.lit(None).cast("long")).unionByName(changes.select("col_id", "val", F.col("seq").cast("long")))
    return both.groupBy("col_id").agg(F.max_by("val", F.coalesce("seq", F.lit(-(1 << 63)))).alias("val"))


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """col_id, val (0 if there is none), there for each id."""
    return ids.select("col_id").join(index, "col_id", "left").select("col_id", F.coalesce("val", F.lit(0)).alias("val"), F.col("val").isNotNull().alias("there"))


def slices(index: DataFrame, bits: int) -> DataFrame:
    """slice, col_id for each set bit of a value."""
    at = index.select("col_id", "val", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("slice"))
    return at.where("getbit(val, slice) = 1").select("slice", "col_id")


def sliced_total(index: DataFrame, bits: int) -> DataFrame:
    """The sum of all values by the cardinalities of their slices."""
    return slices(index, bits).groupBy("slice").agg(F.count("*").alias("n")).agg(F.sum(F.expr("shiftleft(n, slice)")).alias("total"))


def sliced_compare(index: DataFrame, threshold: int, bits: int, key: str = "col_id") -> DataFrame:
    """key, sign (-1, 0, 1 against threshold) by a walk over the slices from the highest: the first that differs decides."""
    walk = F.aggregate(
        F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)),
        F.lit(0),
        lambda sign, i: F.when(sign != 0, sign).otherwise(F.getbit("val", i).cast("int") - F.getbit(F.lit(threshold).cast("long"), i).cast("int")),
    )
    return index.select(key, walk.alias("sign"))


def sliced_top_k(index: DataFrame, k: int, bits: int) -> DataFrame:
    """top_k by descent over the slices, DIGIT of them a pass: a value is kept or left by counts alone; ties drop the smallest ids."""
    if k < 0:
        raise ValueError("k is negative")
    floor_, left, high = 0, k, bits
    while high:
        low = max(0, high - DIGIT)
        same = index.where(F.shiftrightunsigned("val", high) == floor_ >> high) if high < 64 else index
        digit = F.shiftrightunsigned("val", low).bitwiseAND((1 << (high - low)) - 1)
        counts = sorted(map(tuple, same.groupBy(digit.alias("d")).agg(F.count("*")).collect()), reverse=True)  # 2**DIGIT rows at most
        at = 0
        for at, n in counts:
            if n >= left:
                break
            left -= n
        else:
            return index.select("col_id") if k else index.select("col_id").limit(0)
        floor_, high = floor_ | at << low, low
    sure, tied = index.where(F.col("val") > floor_), index.where(F.col("val") == floor_)
    return sure.select("col_id").unionByName(tied.orderBy(F.desc("col_id")).limit(left).select("col_id"))


def extremes(index: DataFrame) -> DataFrame:
    """One row: smallest and largest value, ids, slices in use."""
    return index.agg(F.min("val").alias("low"), F.max("val").alias("high"), F.count("*").alias("ids"), F.length(F.bin(F.max("val"))).cast("long").alias("bits"))


def write(index: DataFrame, path: str, rows: int = 1 << 20):
    """A written index: files sorted by value, so that a predicate on values reads few of them. rows: about how many a file holds."""
    n = max(1, -(-index.count() // rows))
    index.repartitionByRange(n, "val").sortWithinPartitions("val").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
