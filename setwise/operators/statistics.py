"""Physical statistics: what chunks of a set would take as arrays, bitmaps or runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setwise.operators.order import dealt

#: Fixed values of the portable format: an array chunk holds at most so many values; bytes of a bitmap chunk.
ARRAY_MOST, BITMAP_BYTES = 4096, 8192


def chunks(sets: DataFrame) -> DataFrame:
    """set_id, chunk, card, runs, kind (array, bitmap or run: the smallest), bytes."""
    inside = W.partitionBy("set_id", "chunk").orderBy("v")
    keyed = dealt(sets).withColumn("new", F.when(F.lag("v").over(inside) + 1 == F.col("v"), 0).otherwise(1))
    out = keyed.groupBy("set_id", "chunk").agg(F.count("*").alias("card"), F.sum("new").alias("runs"))
    plain = F.when(F.col("card") <= ARRAY_MOST, 2 * F.col("card")).otherwise(F.lit(BITMAP_BYTES).cast("long"))
    as_runs = 2 + 4 * F.col("runs")
    kind = F.when(as_runs < plain, "run").when(F.col("card") <= ARRAY_MOST, "array").otherwise("bitmap")
    return out.withColumn("kind", kind).withColumn("bytes", F.least(plain, as_runs))


def summary(sets: DataFrame) -> DataFrame:
    """set_id, arrays, bitmaps, runs, array_card (values in arrays), array_share, mean_array_card."""
    c = chunks(sets)
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    out = c.groupBy("set_id").agg(kind("array").alias("arrays"), kind("bitmap").alias("bitmaps"), kind("run").alias("runs"), F.coalesce(F.sum(F.when(F.col("kind") == "array", F.col("card"))), F.lit(0)).alias("array_card"))
    n = F.col("arrays") + F.col("bitmaps") + F.col("runs")
    mean = F.when(F.col("arrays") > 0, F.col("array_card") / F.col("arrays"))
    shares = {f"{k}_share": F.col(f"{k}s") / n for k in ("array", "bitmap", "run")}
    return out.withColumns({**shares, "mean_array_card": mean})


def collection_summary(sets: DataFrame) -> DataFrame:
    """One row: chunks, arrays, bitmaps, runs, array_card of all sets together."""
    s = summary(sets)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return s.agg(F.count("*").alias("sets"), *[total(c).alias(c) for c in ("arrays", "bitmaps", "runs", "array_card")])


def memory_size(sets: DataFrame) -> DataFrame:
    """set_id, bytes: an estimate of a set's chunks in memory: 8, and for each chunk 2 and 4 + 2 a value, 8,192, or 4 + 4 a run."""
    body = F.when(F.col("kind") == "array", 4 + 2 * F.col("card")).when(F.col("kind") == "bitmap", F.lit(BITMAP_BYTES)).otherwise(4 + 4 * F.col("runs"))
    return chunks(sets).groupBy("set_id").agg((8 + F.sum(2 + body)).cast("long").alias("bytes"))


def recommend(stats: DataFrame) -> DataFrame:
    """stats with advice: which layout suits most chunks. Shares of 0.75 (arrays) and 0.8 (runs) and a mean of 2,048 values decide."""
    n = F.col("arrays") + F.col("bitmaps") + F.col("runs")
    advice = F.when(n == 0, "empty").when((F.col("arrays") / n > 0.75) & (F.col("mean_array_card") < 2048), "rows").when(F.col("arrays") / n > 0.75, "words").when(F.col("runs") / n > 0.8, "ranges").otherwise("packed")
    return stats.withColumn("advice", advice)


def portable_size(sets: DataFrame) -> DataFrame:
    """set_id, bytes that the portable writer emits."""
    c = chunks(sets).groupBy("set_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("body"), F.max((F.col("kind") == "run").cast("int")).alias("run"))
    n = F.col("n")
    plain = 8 + 8 * n
    with_runs = 4 + F.ceil(n / 8) + 4 * n + F.when(n >= 4, 4 * n).otherwise(0)
    return c.select("set_id", (F.when(F.col("run") == 1, with_runs).otherwise(plain) + F.col("body")).cast("long").alias("bytes"))


def size_bound(card, universe):
    """Most bytes that a set of card values below universe takes: of numbers a number, of Columns a Column."""
    if not isinstance(card, Column) and not isinstance(universe, Column):
        n = min(-(-universe // 65536), card)
        return max(8, 4 + -(-n // 8)) + 8 * n + min(2 * card, 8192 * n)
    card, universe = (x if isinstance(x, Column) else F.lit(x) for x in (card, universe))
    n = F.least(F.ceil(universe / 65536), card)
    return (F.greatest(F.lit(8), 4 + F.ceil(n / 8)) + 8 * n + F.least(2 * card, 8192 * n)).cast("long")
