"""Three layouts of a collection of sets: rows (set_id, v), words (set_id, w, bits) and packed (set_id, bucket, bits).

Rows are the source of truth; the others aggregate to 64 and 32,768 values a row with map-side partial aggregation, and
are co-partitioned by word or bucket, so that set operations on them shuffle far less than on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setwise.operators.order import runs


def to_words(sets: DataFrame) -> DataFrame:
    """set_id, w, bits: bit i of word w stands for value 64 w + i."""
    bits = F.expr("shiftleft(1L, cast(v & 63 as int))")
    return sets.groupBy("set_id", F.shiftright("v", 6).alias("w")).agg(F.bit_or(bits).alias("bits"))


def from_words(words: DataFrame) -> DataFrame:
    at = words.select("set_id", "w", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return at.where("getbit(bits, i) = 1").select("set_id", (F.col("w") * 64 + F.col("i")).alias("v"))


def to_packed(sets: DataFrame) -> DataFrame:
    """set_id, bucket, bits (4,096 bytes): Spark's bitmap functions, where value 0 has bucket 0 to itself."""
    packed = F.expr("bitmap_construct_agg(bitmap_bit_position(v))")
    return sets.groupBy("set_id", F.expr("bitmap_bucket_number(v)").alias("bucket")).agg(packed.alias("bits"))


def word_algebra(words: DataFrame, op: str, n_sets: int | Column | None = None) -> DataFrame:
    """w, bits of the wide and/or/xor of all sets of words. An `and` needs the number of sets, empty ones included: a word that one lacks is empty."""
    merge = {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[op]("bits")
    out = words.groupBy("w").agg(merge.alias("bits"), F.count("*").alias("n"))
    if op == "and":
        out = out.where(F.col("n") == F.lit(0 if n_sets is None else n_sets))
    return out.where("bits <> 0").select("w", "bits")


def packed_cardinality(packed: DataFrame) -> DataFrame:
    """set_id, card."""
    return packed.groupBy("set_id").agg(F.sum(F.expr("bitmap_count(bits)")).alias("card"))


def packed_union(packed: DataFrame) -> DataFrame:
    """bucket, bits of the union of all sets."""
    return packed.groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def packed_intersection(packed: DataFrame, n_sets: int | Column) -> DataFrame:
    """bucket, bits of the intersection; buckets that a set lacks are empty."""
    return packed.groupBy("bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count("*").alias("n")).where(F.col("n") == F.lit(n_sets)).drop("n")


class BuildOptions:
    """How a collection is laid out: by what its chunks are said to hold. The sets are the same in any layout."""

    def __init__(self, layout: str = "rows"):
        self.layout = layout

    @classmethod
    def optimise_for_arrays(cls) -> BuildOptions:
        return cls("rows")

    @classmethod
    def optimise_for_runs(cls) -> BuildOptions:
        return cls("runs")

    @classmethod
    def constant_memory(cls) -> BuildOptions:
        return cls("words")

    @classmethod
    def expected_values_per_chunk(cls, count: int) -> BuildOptions:
        """Under 4,096 rows, under 16,384 words, else runs."""
        if not 0 <= count <= 1 << 16:
            raise ValueError("a chunk holds 0 to 65,536 values")
        return cls("rows" if count < 4096 else "words" if count < 1 << 14 else "runs")

    @classmethod
    def expected_density(cls, density: float) -> BuildOptions:
        return cls.expected_values_per_chunk(int(0xFFFF * density))


def build(sets: DataFrame, options: BuildOptions) -> DataFrame:
    """sets (set_id, v, repeats allowed) in the layout of options: rows, words (set_id, w, bits) or runs (set_id, start, end)."""
    return {"rows": lambda s: s.distinct(), "words": to_words, "runs": lambda s: runs(s.distinct())}[options.layout](sets.select("set_id", "v"))


def unbuild(built: DataFrame) -> DataFrame:
    """set_id, v of any layout."""
    if "w" in built.columns:
        return from_words(built)
    if "start" in built.columns:
        return built.select("set_id", F.explode(F.sequence("start", "end")).alias("v"))
    return built
