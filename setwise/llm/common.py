"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and 0x09 to 0x0D.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only if a count of it shows at most this many rows, and bytes where its rows differ in width.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where all of Spark is in this process, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        got = sc._jsc.sc().getCheckpointDir()
        named = got.get() if got.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="setwise-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/setwise-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands what this process has freed back to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def tidy(run):
    """run, for mapInArrow, after which the worker gives memory back: workers are used again, so that one stage's would count beside the next one's."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """Join with a written table: by broadcast if a count (and the sum of width, the bytes of a row) shows that it is small, otherwise by a sort-merge join whose hot keys Spark splits (adaptive skew join)."""
    rows, size = right.limit(most + 1).agg(F.count("*"), F.sum(F.lit(0) if width is None else width)).first()
    small = rows <= most and (size or 0) <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def squash(line: Column) -> Column:
    """A line in normal form: lower case, one space between words, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " ")))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null and empty texts share one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that df has no columns of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out
