"""One set (v) as a growing array of bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(a: DataFrame, start: int, end: int) -> DataFrame:
    """The bits of [start, end), counted from start."""
    if not 0 <= start <= end:
        raise ValueError("negative or inverted range")
    return a.where((F.col("v") >= start) & (F.col("v") < end)).select((F.col("v") - start).alias("v"))


def measures(a: DataFrame) -> DataFrame:
    """One row: length (the highest bit and one), size (length up to whole words, 0 if empty), card, empty."""
    length = F.coalesce(F.max("v") + 1, F.lit(0))
    return a.agg(length.alias("length"), (F.ceil(length / 64) * 64).cast("long").alias("size"), F.count("*").alias("card"), (F.count("*") == 0).alias("empty"))


def to_bytes(a: DataFrame) -> DataFrame:
    """byte (its number), value: the bytes of the array, the lowest bit first, without the zero ones."""
    bit = F.expr("shiftleft(1, cast(v & 7 as int))")
    return a.groupBy(F.shiftright("v", 3).alias("byte")).agg(F.bit_or(bit).alias("value"))


def to_byte_array(a: DataFrame) -> DataFrame:
    """One row: data, all bytes up to the highest bit as one value. For sets that fit a row."""
    top = a.agg(F.max(F.shiftright("v", 3)).alias("top"))
    every = top.where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("byte"))
    digits = every.join(to_bytes(a), "byte", "left").select("byte", F.lpad(F.hex(F.coalesce("value", F.lit(0))), 2, "0").alias("hex"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("byte", "hex"))), lambda x: x["hex"])
    return digits.agg(F.unhex(F.array_join(rows, "")).alias("data"))
