"""Order statistics over relations (set_id, v).

Ranks are taken by chunk: values of one chunk (65,536 at most) are numbered in their own window, and a small table of
chunk cardinalities holds the running sum before each chunk. No window ever holds a whole set, however large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setwise.functions.integers import UNIVERSE, chunk_of, signed32


def chunk_sums(sets: DataFrame) -> DataFrame:
    """set_id, chunk, card, before (values in earlier chunks), low, high: the side table for ranks and seeks. It counts v, not rows, so that it reads the same columns as the numbering and the exchange of dealt rows serves both."""
    chunk = F.col("chunk") if "chunk" in sets.columns else chunk_of(F.col("v")).alias("chunk")  # of dealt rows
    per = sets.groupBy("set_id", chunk).agg(F.count("v").alias("card"), F.min("v").alias("low"), F.max("v").alias("high"))
    earlier = W.partitionBy("set_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum("card").over(earlier), F.lit(0)))


def dealt(sets: DataFrame) -> DataFrame:
    """set_id, v, chunk, dealt by set and chunk once: numbers within a chunk and the chunks' own table share the exchange."""
    keyed = sets.select("set_id", "v", chunk_of(F.col("v")).alias("chunk"))
    return keyed.where("set_id is not null and chunk is not null").repartition("set_id", "chunk")  # what a later join on them would filter on one side only


def _numbered(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("k", F.row_number().over(W.partitionBy("set_id", "chunk").orderBy("v")))


def ranked(sets: DataFrame) -> DataFrame:
    """set_id, v, rank: values at or below v, from 1."""
    keyed = dealt(sets)
    return _numbered(keyed).join(chunk_sums(keyed).select("set_id", "chunk", "before"), ["set_id", "chunk"]).select("set_id", "v", (F.col("before") + F.col("k")).alias("rank"))


def rank_of(sets: DataFrame, x: int) -> DataFrame:
    """set_id, rank: values at or below x."""
    return sets.groupBy("set_id").agg(F.count(F.when(F.col("v") <= x, 1)).alias("rank"))


def _stretch(sets: DataFrame, first: int, end: int) -> DataFrame:
    """set_id, v of each set's values of ranks first + 1 to end: of the chunks that reach into them, only those at the ends are numbered."""
    keyed = dealt(sets)
    reach = chunk_sums(keyed).where((F.col("before") < end) & (F.col("before") + F.col("card") > first)).select("set_id", "chunk", "before", "card")
    inside = keyed.join(reach, ["set_id", "chunk"])
    whole = (F.col("before") >= first) & (F.col("before") + F.col("card") <= end)
    rank = F.col("before") + F.col("k")
    some = _numbered(inside.where(~whole)).where((rank > first) & (rank <= end))
    return inside.where(whole).select("set_id", "v").unionByName(some.select("set_id", "v"))


def select(sets: DataFrame, j: int) -> DataFrame:
    """set_id, v: the j-th smallest value, from 0. Sets of j values or fewer have no row."""
    return _stretch(sets, j, j + 1)


def limit(sets: DataFrame, k: int) -> DataFrame:
    """The k smallest values of each set."""
    return _stretch(sets, 0, k)


def page(sets: DataFrame, size: int, number: int) -> DataFrame:
    """The number-th page, from 0, of size values of each set."""
    return _stretch(sets, size * number, size * (number + 1))


def seek(sets: DataFrame, x: int) -> DataFrame:
    """The values at or above x: what an iterator gives that was advanced to x."""
    return sets.where(F.col("v") >= x)


def peek(sets: DataFrame, x: int) -> DataFrame:
    """set_id, next: the value that such an iterator gives next; no row for sets without one."""
    return seek(sets, x).groupBy("set_id").agg(F.min("v").alias("next"))


def ends(sets: DataFrame) -> DataFrame:
    """set_id, first, last, first_signed, last_signed."""
    s = signed32(F.col("v"))
    return sets.groupBy("set_id").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.min(s).alias("first_signed"), F.max(s).alias("last_signed"))


def neighbours(sets: DataFrame, x: int) -> DataFrame:
    """set_id, next_value (smallest at or above x), previous_value (largest at or below x); -1 if there is none."""
    v = F.col("v")
    return sets.groupBy("set_id").agg(F.coalesce(F.min(F.when(v >= x, v)), F.lit(-1)).alias("next_value"), F.coalesce(F.max(F.when(v <= x, v)), F.lit(-1)).alias("previous_value"))


def _pieces(keyed: DataFrame) -> DataFrame:
    """set_id, chunk, start, end of the stretches of consecutive values within a chunk."""
    island = F.col("v") - F.row_number().over(W.partitionBy("set_id", "chunk").orderBy("v"))
    return keyed.withColumn("island", island).groupBy("set_id", "chunk", "island").agg(F.min("v").alias("start"), F.max("v").alias("end")).drop("island")


def runs(sets: DataFrame) -> DataFrame:
    """set_id, start, end (inclusive) of the stretches of consecutive values.

    Stretches are found chunk by chunk; those that touch at a chunk's border are then joined over the few that do."""
    pieces = _pieces(dealt(sets)).select("set_id", "start", "end")
    touches = ((F.col("start") % 65536) == 0) | ((F.col("end") % 65536) == 65535)
    by_start = W.partitionBy("set_id").orderBy("start")
    edge = pieces.where(touches).withColumn("new", F.when(F.lag("end").over(by_start) + 1 == F.col("start"), 0).otherwise(1))
    edge = edge.withColumn("run", F.sum("new").over(by_start)).groupBy("set_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
    return pieces.where(~touches).unionByName(edge)


def absent_neighbours(sets: DataFrame, x: int, top: int = (1 << 32) - 1) -> DataFrame:
    """set_id, next_absent (smallest value at or above x that is not in the set), previous_absent; -1 if there is none."""
    r = runs(sets)
    at = (F.col("start") <= x) & (F.col("end") >= x)
    got = r.groupBy("set_id").agg(F.max(F.when(at, F.col("end") + 1)).alias("up"), F.max(F.when(at, F.col("start") - 1)).alias("down"))
    up = F.coalesce("up", F.lit(x))
    return got.select("set_id", F.when(up > top, -1).otherwise(up).alias("next_absent"), F.coalesce("down", F.lit(x)).alias("previous_absent"))


def _check_range(start: int, length: int):
    if start < 0 or length < 0 or start + length > UNIVERSE:
        raise ValueError("range outside [0, 2**32]")


def presence(a: DataFrame, start: int, length: int) -> DataFrame:
    """position (from 0), present for every value of [start, start + length) of one set. presence_runs tells the same in few rows."""
    _check_range(start, length)
    here = a.where((F.col("v") >= start) & (F.col("v") < start + length)).select("v", F.lit(True).alias("had"))
    return a.sparkSession.range(start, start + length).withColumnRenamed("id", "v").join(here, "v", "left").select((F.col("v") - start).alias("position"), F.coalesce("had", F.lit(False)).alias("present"))


def present_positions(a: DataFrame, start: int, length: int) -> DataFrame:
    """position (from 0) of each value of [start, start + length) in one set: presence without the absent ones."""
    _check_range(start, length)
    return a.where((F.col("v") >= start) & (F.col("v") < start + length)).select((F.col("v") - start).alias("position"))


def presence_runs(a: DataFrame, start: int, length: int) -> DataFrame:
    """first, last (positions from 0, inclusive), present: the stretches of [start, start + length) that one set has, cut at chunks, and those between them."""
    _check_range(start, length)
    if not length:
        return a.sparkSession.range(0).selectExpr("id AS first", "id AS last", "true AS present")
    keyed = dealt(a.where((F.col("v") >= start) & (F.col("v") < start + length)).select(F.lit(0).alias("set_id"), "v"))
    by_chunk = W.partitionBy("set_id").orderBy("chunk")
    beyond = chunk_sums(keyed).select("set_id", "chunk", F.lead("low").over(by_chunk).alias("beyond"))
    rows = _pieces(keyed).withColumn("next", F.lead("start").over(W.partitionBy("set_id", "chunk").orderBy("start"))).join(beyond, ["set_id", "chunk"])
    rows = rows.withColumn("next", F.coalesce("next", "beyond", F.lit(start + length)))
    stretch = lambda x, y, there: F.struct((x - start).alias("first"), (y - start).alias("last"), F.lit(there).alias("present"))
    gap = F.when(F.col("next") > F.col("end") + 1, stretch(F.col("end") + 1, F.col("next") - 1, False))
    out = rows.select(F.explode(F.array_compact(F.array(stretch(F.col("start"), F.col("end"), True), gap))).alias("r")).select("r.*")
    low = F.coalesce("low", F.lit(start + length))
    head = keyed.agg(F.min("v").alias("low")).where(low > start).select(stretch(F.lit(start).cast("long"), low - 1, False).alias("r")).select("r.*")
    return out.unionByName(head)


def as_of(sets: DataFrame, probes: DataFrame) -> DataFrame:
    """set_id, x, next_value, previous_value (-1 if none) for every probe (set_id, x): seeks in the probe's own chunk, then in the side table."""
    both = sets.select("set_id", F.col("v").alias("x"), F.lit(True).alias("own")).unionByName(probes.select("set_id", "x", F.lit(False).alias("own")).distinct())
    both = both.withColumn("chunk", chunk_of(F.col("x")))
    value = F.when(F.col("own"), F.col("x"))
    here = W.partitionBy("set_id", "chunk").orderBy("x")
    near = both.withColumn("up", F.min(value).over(here.rangeBetween(0, W.unboundedFollowing))).withColumn("down", F.max(value).over(here.rangeBetween(W.unboundedPreceding, 0)))
    near = near.where("not own")
    lines = chunk_sums(sets).select("set_id", "chunk", "low", "high").unionByName(near.select("set_id", "chunk").distinct().withColumns({"low": F.lit(None).cast("long"), "high": F.lit(None).cast("long")}))
    lines = lines.groupBy("set_id", "chunk").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    by = W.partitionBy("set_id").orderBy("chunk")
    lines = lines.withColumn("after", F.min("low").over(by.rowsBetween(1, W.unboundedFollowing))).withColumn("before", F.max("high").over(by.rowsBetween(W.unboundedPreceding, -1)))
    return near.join(lines, ["set_id", "chunk"]).select("set_id", "x", F.coalesce("up", "after", F.lit(-1)).alias("next_value"), F.coalesce("down", "before", F.lit(-1)).alias("previous_value"))
