"""Append-only builders on Structured Streaming: words of sets that grow as values arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def growing_words(values: DataFrame) -> DataFrame:
    """set_id, w, bits of a stream (set_id, v): state is one word a key, whatever the number of values. Output mode update or complete."""
    return values.groupBy("set_id", F.shiftright("v", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v & 63 as int))")).alias("bits"))


def windowed_cardinality(events: DataFrame, ts: str, late: str, width: str) -> DataFrame:
    """window, set_id, card: values of each set (set_id, v, ts) in each window, counted approximately; rows later than `late` are dropped and state is given up behind the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "set_id").agg(F.approx_count_distinct("v").alias("card"))


def new_values(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows of (set_id, v, ts) whose value the set did not have within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["set_id", "v"])
