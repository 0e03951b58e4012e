"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length within each source. A source's target is met by whole passes over it plus
a part that a bounded knapsack over the length counts fits to the word; which documents of a length are taken is
decided by a seeded hash. Sources get weights in the order of their names by code point (null last), repeating, share
`share` times all words, and stop at `most` times their own size; what is above is shared out again by weight.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own; a source
without words has target 0; repeated rows are separate documents, of which any may be taken (the rows are equal);
an empty table gives an empty result; other columns are ignored. Reruns give the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setwise.llm.common import lookup, materialise, n_words, table, unused

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2.0, 20
#: Words of a budget that are left to the dynamic programme; documents of one length and salt.
WINDOW, SALT_ROWS = 1 << 14, 512
#: Sums that the dynamic programme tells apart; a remainder of more words (documents of millions of words each) is counted in units of 1 / LARGEST of twice itself.
LARGEST = 1 << 24


def bounded_knapsack(lengths: list[int], counts: list[int], goal: int) -> list[int]:
    """How many of each length (at most counts) give the sum nearest to goal; the smaller of two equally near.

    Of goals beyond LARGEST / 2 the sums are counted in units, and may be off by half a unit for each document taken."""
    take = [0] * len(lengths)
    if goal <= 0 or not lengths:
        return take
    unit = -(-2 * goal // LARGEST)
    if unit > 1:
        lengths, goal = [max(1, round(n / unit)) for n in lengths], round(goal / unit)
    limit = 2 * goal
    reached, mask, items = 1, (1 << (limit + 1)) - 1, []
    first = np.full(limit + 1, -1, np.int32)  # the item that reached a sum first
    for i, (length, count) in enumerate(zip(lengths, counts)):
        part = 1
        while count and length <= limit:
            n = min(part, count)
            count, part = count - n, part * 2
            new = (reached << (n * length)) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits[: limit + 1])] = len(items)
                items.append((i, n))
                reached |= new
        if reached >> goal & 1:
            break
    below = (reached & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reached >> (goal + 1)
    above = goal + (above & -above).bit_length() if above else None
    at = below if above is None or goal - below <= above - goal else above
    while at:
        i, n = items[first[at]]
        take[i] += n
        at -= n * lengths[i]
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """Documents to take of each length so that the words come as near to budget as can be found.

    The bulk is the same share of each length; greedy steps bring the rest down to a window, which the knapsack fits."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    spare = min(budget, WINDOW)
    take = np.minimum(counts, np.floor(counts * ((budget - spare) / total)).astype(np.int64))
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] > 0 and rest - spare >= lengths[i]:
            n = min(int(counts[i] - take[i]), (rest - spare) // int(lengths[i]))
            take[i] += n
            rest -= n * int(lengths[i])
    at = [i for i in np.random.default_rng(seed).permutation(len(lengths)) if lengths[i] > 0 and take[i] < counts[i] and lengths[i] <= 2 * rest]
    for i, n in zip(at, bounded_knapsack([int(lengths[i]) for i in at], [int(counts[i] - take[i]) for i in at], rest)):
        take[i] += n
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    size, goal = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    passes = int(goal // size) if size else 0
    extra = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(goal - passes * size)) if size else np.zeros(len(pdf), np.int64)
    return pd.DataFrame({"sid": pdf.sid, "size": pdf["size"], "n": pdf["n"], "passes": passes, "extra": extra, "source_size": size, "target": goal})


def _numbered(df: DataFrame, col: str) -> DataFrame:
    """df with sid, the place of col from 0 in code-point order (null last), without one task for all rows."""
    order = F.col(col).asc_nulls_last()
    parts = materialise(df.repartitionByRange(16, order).withColumn("part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    ranked = parts.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy(order)))
    return ranked.join(F.broadcast(before.select("part", "before")), "part").select(*df.columns, (F.col("k") - 1 + F.coalesce("before", F.lit(0))).alias("sid"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with sid and target. Each round is one aggregate over the sources and fixes those that reach their stop."""
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = materialise(_numbered(sources, "source").withColumn("weight", pick), "sources")
    stop = F.col("source_size") * F.lit(most)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at = stop <= F.col("weight") * F.lit(level)
        n, held, open_weight = rows.agg(F.sum(at.cast("int")), F.sum(F.when(at, stop).otherwise(0.0)), F.sum(F.when(at, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or n == full:
            break
        level, full = (total * share - held) / open_weight, n
    return rows.withColumn("target", F.least(stop, F.col("weight") * F.lit(level)) if total else F.lit(0.0))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source)."""
    # Rows without a doc_id are told apart by their texts, so that no salt takes them all.
    mark = F.xxhash64(F.lit(seed), F.when(F.col("doc_id").isNull(), F.col("text")), "doc_id").alias("h")
    light = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mark), "sizes")
    counts = materialise(light.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sources = materialise(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "targets")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    named = lambda df, cols: df.alias("a").join(F.broadcast(sources.alias("b")) if few else sources.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in cols])
    few = sources.limit(20_001).count() <= 20_000
    plan = materialise(named(counts, ["sid", "source_size", "target"]).drop("source").groupBy("sid").applyInPandas(_plan, "sid long, size long, n long, passes int, extra long, source_size long, target double"), "plan")
    rows = lookup(named(light, ["sid"]), plan, ["sid", "size"])
    kept = ["doc_id", "source", "size", "source_size", "target"]
    all_or_none = (F.col("extra") == 0) | (F.col("extra") >= F.col("n"))
    sure = rows.where(all_or_none).select(*kept, (F.col("size") * (F.col("passes") + (F.col("extra") > 0).cast("int"))).alias("taken"))
    salted = rows.where(~all_or_none).withColumn("salt", F.pmod("h", F.ceil(F.col("n") / SALT_ROWS)))
    cells = salted.where(F.col("n") > SALT_ROWS).groupBy("sid", "size", "salt").agg(F.count("*").alias("c"))
    cells = materialise(cells.withColumn("before", F.sum("c").over(W.partitionBy("sid", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).drop("c"), "cells")
    ranked = lookup(salted, cells, ["sid", "size", "salt"]).withColumn("k", F.row_number().over(W.partitionBy("sid", "size", "salt").orderBy("h", "doc_id")))
    some = ranked.select(*kept, (F.col("size") * (F.col("passes") + (F.col("k") + F.coalesce("before", F.lit(0)) <= F.col("extra")).cast("int"))).alias("taken"))
    return sure.unionByName(some)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs (all columns) as often as the mix takes them. Rows equal in doc_id, source and size share what they were taken together."""
    took = mix(docs, **how).where("size > 0").groupBy("doc_id", "source", "size").agg(F.sum(F.expr("taken div size")).alias("times"), F.count("*").alias("rows"))
    took = materialise(took.where("times > 0"), "taken")
    size, times, rows, k, copy = unused(docs, "size", "times", "rows", "k", "copy")
    sized = docs.withColumn(size, n_words(F.col("text"))).alias("d")
    join = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col(f"d.{size}") == F.col("t.size"))
    got = sized.join(took.alias("t").hint("merge"), join).select("d.*", F.col("t.times").alias(times), F.col("t.rows").alias(rows))
    one = got.where(F.col(rows) == 1)
    rank = F.row_number().over(W.partitionBy("doc_id", "source", size).orderBy("text"))
    share = F.expr(f"`{times}` div `{rows}`") + (F.col(k) <= F.col(times) % F.col(rows)).cast("int")
    more = got.where(F.col(rows) > 1).withColumn(k, rank).withColumn(times, share).drop(k)
    both = one.unionByName(more).where(F.col(times) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def op1(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
