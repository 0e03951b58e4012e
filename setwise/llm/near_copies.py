"""SimHash near-dedup at a similarity of shingles: texts link at a Jaccard similarity of SIMILAR or more of their sets of
WIDTH-word shingles.

At that similarity a bit of one set's SimHash differs from the other's with a probability of 0.15, so a 64-bit
fingerprint differs by 10 bits on average and by up to 20 and more, where no choice of equal blocks finds the pairs. A
fingerprint here is WORDS of them side by side: the operator's own (the shingles' XXH64) and as many of the same values
mixed on. It is dealt by blocks of its bits, as op9's: two texts meet in a bucket where they agree on a block. Blocks are
of `width` bits, more where there are more texts, and there are so many of them that a pair at the similarity itself
agrees on none with a probability of e**-MISS, 2 in ten million (sets of 4 and 5 shingles, whose bits differ most, with
2 in 100,000, rising to 2 in 10,000 at 13 million texts); closer pairs with less. In a bucket, texts are compared by
size, by the table of their distances to pivot fingerprints, which are members of the bucket, and by the WIDE first bits,
of which at most WIDE_FAR may differ (more differ with 2 in ten million; of sets of 4 and 5 shingles, 5 in 100,000).
What that connects is a group, and texts of a group are candidates: those whose first 64 bits differ by more than FAR are
discarded (six standard errors at the similarity), again by pivots where many are compared, and every survivor is
verified on the whole shingle sets.

First each group's members are compared with its smallest. Then, in groups that still hold several components, members
are compared with those of other components by breadth-first search, inside a task, until nothing is left to link: a
task hands on a spanning forest, never the pairs. Before texts or shingle sets are fetched for either, the whole
fingerprints discard pairs that differ by more than ALL_FAR of their 1024 bits (eight standard errors above what sets of 4
and 5 shingles differ by, unrelated texts being thirteen below 512). What such pairs of all groups connect is searched as
one, so that a text's shingle set goes to one task, and to one for each block where that is large. A bucket or group of more than MOST members or a group of more than PART
shingles is cut into blocks, and each two blocks meet in a task of their own, so that no link is lost and no task holds a
hot one.

Words are those of op9's fingerprints; fewer than WIDTH words make one shingle, and texts without words are copies of
each other. Equal sets are one node.

Defined results: null, empty and blank texts are one class; a null doc_id never names a class unless all in it are null;
rows that share a doc_id or have none are told apart by their texts; repeated rows each get a row of near_copies, and near_deduplicated keeps one of them; an empty table gives an empty
result; near_deduplicated keeps all columns of the rows that stay.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setwise.llm.common import LOWER, UPPER, lookup, materialise, tidy
from setwise.llm.simhash import components, first_of, hexed, lowest, marked, pivot_fingerprints, popcount

WIDTH, SIMILAR, SEED, FAR = 5, (4, 5), 42, 27
WORDS, WIDE, WIDE_FAR, ALL_FAR, MISS, DIFFERS = 16, 128, 42, 300, 15.5, 0.1515
#: Texts that a bucket holds on average, at most, and the fewest bits of a block; rows that a worker compares at once.
BUCKET, LEAST, TOGETHER = 512, 10, 200_000
MOST, PART = 2048, 1 << 22
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RNG = np.random.default_rng(SEED)
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
#: A byte's bits as the bytes of a long, so that sums of up to 255 of them are counts of bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at ASCII space, 0x09 to 0x0D
    n = max(1, len(words) - WIDTH + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + WIDTH]), SEED) for i in range(n)), np.uint64, n))


def wide_simhash(found: np.ndarray) -> np.ndarray:
    """WORDS fingerprints of a set of shingles, the first of them simhash_of it."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), 255):
        x = found[at : at + 255, None] * _TIMES[0]
        x ^= x >> np.uint64(32)
        x *= _TIMES[1]
        x ^= x >> np.uint64(29)
        x[:, 0] = found[at : at + 255]
        counts += np.add.reduce(_SPREAD.take(x.view(np.uint8)), 0).view(np.uint8)
    return np.packbits(counts * 2 > len(found), bitorder="little").view("<u8").astype(np.uint64)


def blocks(n: int) -> np.ndarray:
    """For n texts, the bits (of 64 * WORDS) of each block: each row is one."""
    width = max(LEAST, math.ceil(math.log2(max(n, 1) / BUCKET)))
    many, each = math.ceil(MISS / (1 - DIFFERS) ** width), 64 * WORDS // width
    rng = np.random.default_rng(SEED)
    return np.concatenate([rng.permutation(64 * WORDS)[: each * width].reshape(each, width) for _ in range(-(-many // each))])[:many]


def keys_of(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of each fingerprint (a row of WORDS longs) by each block of at."""
    bits = np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    got = np.zeros((len(wide), len(at)), np.int64)
    for k in range(at.shape[1]):
        got |= bits[:, at[:, k]].astype(np.int64) << k
    return got | np.arange(len(at)) << at.shape[1]


def _wide(column: pa.Array) -> np.ndarray:
    """The fingerprints of a column of wide: a row of WORDS longs each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WORDS)


def _dealt(at: np.ndarray):
    """Rows (fp, n, wide): key (the bucket, and below bit 32 the size of the set), fp and the WIDE first bits for each block."""

    def run(batches):
        for part in _parts(batches, 2048):
            fp, n = (part.column(k).to_numpy() for k in (0, 1))
            wide = _wide(part.column(2))
            key = keys_of(wide, at) << 32 | np.minimum(n, (1 << 31) - 1)[:, None]
            each = [np.repeat(x, len(at)) for x in (fp, wide[:, 0].astype(np.int64), wide[:, 1].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel(), *each)], names=["key", "fp", "one", "two"])

    return run


def grouped(key: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of rows sorted by key, the first that sizes, pivots and WIDE bits connect each with inside its bucket."""
    bucket, n, total = key >> 32, key & 0xFFFFFFFF, len(key)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if total else np.zeros(0, int)
    size = np.diff(np.r_[first, total])
    tables = []
    for q in range(4):  # pivots are members of the bucket: they tell a large group of copies from all else
        p = np.repeat(first + size * q // 4, size)
        tables.append((popcount(one ^ one[p]) + popcount(two ^ two[p])).astype(np.int16))
    root, live, k = np.arange(total), np.arange(total), 0
    while len(live):
        k += 1
        live = live[live < total - k]
        live = live[(bucket[live + k] == bucket[live]) & (n[live + k] * SIMILAR[0] <= n[live] * SIMILAR[1])]
        i = live[root[live] != root[live + k]]
        for t in tables:
            i = i[np.abs(t[i] - t[i + k]) <= WIDE_FAR]
        i = i[popcount(one[i] ^ one[i + k]) + popcount(two[i] ^ two[i + k]) <= WIDE_FAR]
        root = _united(root, i, i + k)
    return root


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (the first row of each row's component) with rows i and j linked."""
    a, b = root[i], root[j]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _grouped(batches):
    """Rows (key, fp, one, two) come sorted by key: b, fp, n of the groups of several in each bucket, each group's smallest fp (c), and whether sizes and fingerprints let c and fp be a pair; equal groups have one b."""
    held, rows = [], 0

    def flush(key, fp, one, two):
        root = grouped(key, one.view(np.uint64), two.view(np.uint64))
        many = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        many = many[np.argsort(root[many], kind="stable")]
        new = np.flatnonzero(np.diff(root[many], prepend=-1))
        x = fp[many].view(np.uint64) * _TIMES[0, 0]
        x = (x ^ x >> np.uint64(32)) * _TIMES[1, 0]
        b = np.add.reduceat(x ^ x >> np.uint64(29), new) if len(new) else x
        size = np.diff(np.r_[new, len(many)])
        low = many[np.lexsort((fp[many], root[many]))][new] if len(new) else new
        c, b, n = np.repeat(low, size), np.repeat(b, size), key & 0xFFFFFFFF
        fits = np.minimum(n[many], n[c]) * SIMILAR[1] >= np.maximum(n[many], n[c]) * SIMILAR[0]
        star = fits & (popcount(one[many].view(np.uint64) ^ one[c].view(np.uint64)) <= FAR) & (fp[many] != fp[c])
        columns = [b.view(np.int64), fp[many], n[many], fp[c], star]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["b", "fp", "n", "c", "star"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += len(batch)
        if rows >= TOGETHER:
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(whole[0] >> 32, whole[0][-1] >> 32))  # the last bucket may go on
            if cut:
                yield flush(*(x[:cut] for x in whole))
            held, rows = [[x[cut:] for x in whole]], rows - cut
    if rows:
        yield flush(*(np.concatenate(x) for x in zip(*held)))


def narrowed(group: np.ndarray, root: np.ndarray, n: np.ndarray, sim: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Of rows sorted by group and n, the first that pairs of different roots, near by size and whole fingerprint, connect each with inside its group."""
    total, k = len(group), 0
    first, live = np.arange(total), np.arange(total)
    while len(live):
        k += 1
        live = live[live < total - k]
        live = live[(group[live + k] == group[live]) & (n[live + k] * SIMILAR[0] <= n[live] * SIMILAR[1])]
        i = live[(root[live] != root[live + k]) & (first[live] != first[live + k])]
        i = i[popcount(sim[i] ^ sim[i + k]) <= FAR]
        i = i[popcount(wide[i] ^ wide[i + k]).sum(1) <= ALL_FAR]
        first = _united(first, i, i + k)
    return first


def _narrowed(batches):
    """Rows (b, lo, hi, fp, root, sim, n, wide) come sorted by b, lo, hi, n: c, fp, n, root of those that whole fingerprints leave a partner of another root; c: the first that such pairs connect with fp."""
    held, rows = [], 0

    def flush(new, fp, root, sim, n, wide):
        first = narrowed(np.cumsum(new), root, n, sim.view(np.uint64), wide)
        many = np.flatnonzero(np.bincount(first, minlength=len(first))[first] > 1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[first[many]], fp[many], n[many], root[many])], names=["c", "fp", "n", "root"])

    for batch in batches:
        held.append([*(batch.column(k).to_numpy() for k in range(7)), _wide(batch.column(7))])
        rows += len(batch)
        if rows >= TOGETHER:
            whole = [np.concatenate(x) for x in zip(*held)]
            new = np.logical_or.reduce([np.diff(x, prepend=x[0] - 1) != 0 for x in whole[:3]])
            cut = int(np.flatnonzero(new)[-1])  # the last group may go on
            if cut:
                yield flush(new[:cut], *(x[:cut] for x in whole[3:]))
            held, rows = [[x[cut:] for x in whole]], rows - cut
    if rows:
        whole = [np.concatenate(x) for x in zip(*held)]
        yield flush(np.logical_or.reduce([np.diff(x, prepend=x[0] - 1) != 0 for x in whole[:3]]), *whole[3:])


def simhash_of(found: np.ndarray) -> int:
    """The fingerprint of a set of shingles: bits that are set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        counts += np.unpackbits(found[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


def _parts(batches, rows: int = 1024):
    """batches cut into ones of few rows, of which so much less is held as Python objects at once."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def _prints(batches):
    for batch in _parts(batches):
        sets = [shingles(x.as_py()) for x in batch.column(2)]
        wide = [wide_simhash(x) for x in sets]
        fp, sim = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in ([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], [x[0] for x in wide]))
        columns = [*batch.columns[:2], fp, sim, pa.array([len(x) for x in sets], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in wide], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp", "sim", "n", "wide"])


def alike(both, a, b):
    """Whether sets of a and b shingles, of which they share `both`, reach the similarity (numbers or arrays)."""
    return both * SIMILAR[1] >= SIMILAR[0] * (a + b - both)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))


def _near(batches):
    """Rows (u, v, a, b): u, v of those whose whole fingerprints a and b let them be a pair."""
    for batch in _parts(batches, 8192):
        live = pa.array(popcount(_wide(batch.column(2)) ^ _wide(batch.column(3))).sum(1) <= ALL_FAR)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(live) for k in (0, 1)], names=["u", "v"])


def _verified(batches):
    known = functools.lru_cache(64)(shingles)  # a bucket's smallest member comes many times
    for batch in batches:
        u, v, a, b = (batch.column(k) for k in range(4))
        live = pa.array([similar(known(x.as_py()), known(y.as_py())) for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([u.filter(live), v.filter(live)], names=["u", "v"])


def forest(root: np.ndarray, sim: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) between members of different components that connect all that the similarity connects. root: each member's component so far; sim: fingerprints."""
    size, near = np.array([len(x) for x in sets]), np.stack([popcount(sim ^ p).astype(np.int8) for p in pivot_fingerprints()], 1)
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    here, out = np.zeros(len(vocabulary), bool), []
    left = np.arange(len(sets))
    while len(left):
        own = root[left] == root[left[0]]
        queue, left = left[own].tolist(), left[~own]
        while queue and len(left):
            i = queue.pop()
            maybe = left[(np.abs(near[left] - near[i]) <= FAR).all(1)]  # the pivots' triangle inequality
            maybe = maybe[(popcount(sim[maybe] ^ sim[i]) <= FAR) & alike(np.minimum(size[maybe], size[i]), size[maybe], size[i])]
            if not len(maybe):
                continue
            here[ids[ends[i] - size[i] : ends[i]]] = True
            lens = size[maybe]
            first = np.cumsum(lens) - lens
            at = np.repeat(ends[maybe] - lens - first, lens) + np.arange(lens.sum())
            both = np.add.reduceat(here[ids[at]], first, dtype=np.int64) if lens.all() else np.array([here[ids[ends[j] - size[j] : ends[j]]].sum() for j in maybe])
            here[ids[ends[i] - size[i] : ends[i]]] = False
            hit = maybe[alike(both, lens, size[i])]
            if len(hit):
                joined, one = np.unique(root[hit], return_index=True)
                out += [(i, int(j)) for j in hit[one]]
                gone = np.isin(root[left], joined)
                queue += left[gone].tolist()
                left = left[~gone]
    return out


def _forests(batches):
    """Rows (b, lo, hi, fp, root, sim, set) come sorted by b, lo, hi: u, v of what links the components of a bucket's two blocks."""
    held, key = [], None

    def flush():
        fp, root, sim = (np.array([r[k] for r in held], np.int64) for k in (0, 1, 2))
        links = forest(root, sim.view(np.uint64), [np.frombuffer(r[3], "<u8") for r in held])
        return pa.RecordBatch.from_arrays([pa.array(fp[[x[k] for x in links]].tolist(), pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in _parts(batches):
        for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if row[:3] != key and held:
                yield flush()
                held = []
            key = row[:3]
            held.append(row[3:])
    if held:
        yield flush()


def _sets(batches):
    for batch in _parts(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingles(x.as_py()).astype("<u8").tobytes() for x in batch.column(2)], pa.binary())], names=["fp", "sim", "set"])


def _texts(ids: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """fp, sim, text of each of ids (fp), the text as docs has it: no table holds it a second time. Grows with docs: never broadcast."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "mark"]
    rows = lookup(prints.select("fp", "sim", "doc_id", "mark"), materialise(ids.distinct(), "candidates"), ["fp"], "left_semi")
    rows = materialise(rows.dropDuplicates(["fp"]).select(*key, "fp", "sim"), "places")
    texts = lookup(marked(docs).select(*key, "text"), rows, ["id", "none", "mark"], "inner")
    return materialise(texts.select("fp", "sim", "text").dropDuplicates(["fp"]), "texts")


def _pairs(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """u, v of pairs with a and b, the column of rows (fp, column) of either."""
    pairs = pairs.join(rows.select(F.col("fp").alias("u"), F.col(column).alias("a")).hint("merge"), "u")
    return pairs.join(rows.select(F.col("fp").alias("v"), F.col(column).alias("b")).hint("merge"), "v").select("u", "v", "a", "b")


def _met(left: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """b, lo, hi, fp, root and the columns of rows (fp, ...), dealt so that each two of the k blocks of a group of left (b, k, fp, root) meet in a task."""
    block = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.col("k")).cast("int")
    met = left.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("b", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "root")
    met = met.groupBy("fp").agg(F.collect_list(F.struct("b", "lo", "hi", "root")).alias("own"))  # a text is in a few groups for each block at most
    others = [c for c in rows.columns if c != "fp"]
    met = met.join(rows.hint("merge"), "fp").select("fp", *others, F.inline("own")).select("b", "lo", "hi", "fp", "root", *others)
    return met.repartition("b", "lo", "hi").sortWithinPartitions("b", "lo", "hi", *order)


def _candidates(nodes: DataFrame, most: int) -> DataFrame:
    """b, fp, n, c, star (see _grouped): the groups of nodes (fp, n, wide) to compare."""
    dealt = nodes.select("fp", "n", "wide").mapInArrow(tidy(_dealt(blocks(nodes.count()))), "key long, fp long, one long, two long")
    bucket = F.shiftright("key", 32)
    hot = dealt.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count("*") / most).cast("int").alias("k")).where("k > 1")
    hot = materialise(hot, "hot")
    if hot.count():
        dealt = dealt.withColumn("bucket", bucket)
        cool, again = lookup(dealt, hot.select("bucket"), ["bucket"], "left_anti"), lookup(dealt, hot, ["bucket"], "inner")
        own = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.col("k")).cast("int")
        again = again.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        met = F.pmod(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")), F.lit(1 << 31))  # where two meet by chance, more is compared
        again = again.withColumn("key", F.shiftleft(met, 32).bitwiseOR(F.col("key").bitwiseAND(0xFFFFFFFF)))
        dealt = cool.select("key", "fp", "one", "two").unionByName(again.select("key", "fp", "one", "two"))
    dealt = dealt.repartition(bucket).sortWithinPartitions("key")
    return materialise(dealt.mapInArrow(tidy(_grouped), "b long, fp long, n long, c long, star boolean").distinct(), "groups")


def near_copies(docs: DataFrame, most: int = MOST, part: int = PART) -> DataFrame:
    """doc_id, fingerprint (of the shingle set), component_id, and the mark and first row by which near_deduplicated picks, for each row of docs (doc_id, text)."""
    prints = materialise(marked(docs).mapInArrow(tidy(_prints), "doc_id long, mark binary, fp long, sim long, n long, wide binary"), "shingles")
    nodes = materialise(prints.groupBy("fp").agg(lowest().alias("low"), F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("wide").alias("wide")), "nodes")
    members = _candidates(nodes, most)
    stars = materialise(members.where("star").select(F.col("c").alias("u"), F.col("fp").alias("v")).distinct(), "star_pairs")
    stars = materialise(_pairs(stars, nodes, "wide").mapInArrow(tidy(_near), "u long, v long"), "near_pairs")
    texts = _texts(stars.select(F.col("u").alias("fp")).unionByName(stars.select(F.col("v").alias("fp"))), prints, docs)
    edges = materialise(_pairs(stars, texts, "text").mapInArrow(tidy(_verified), "u long, v long"), "similar")
    roots = materialise(components(edges), "star_roots").withColumnRenamed("node", "fp")
    rooted = materialise(lookup(members.select("b", "fp", "n"), roots, ["fp"]).select("b", "fp", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    pieces = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / part), F.lit(1)).cast("int")
    # A group is part of a bucket of two blocks at most, so that its members fit into a row.
    whole = rooted.groupBy("b").agg(F.min("root").alias("x"), F.max("root").alias("y"), pieces.alias("k"), F.collect_list(F.struct("fp", "root")).alias("own"))
    left = materialise(whole.where("x <> y").select("b", "k", F.inline("own")), "open")
    met = _met(left, nodes.select("fp", "sim", "n", "wide"), "n")
    narrow = materialise(met.mapInArrow(tidy(_narrowed), "c long, fp long, n long, root long").distinct(), "narrowed")
    joined = materialise(components(narrow.select(F.col("c").alias("u"), F.col("fp").alias("v"))), "joined").toDF("fp", "b")
    left = lookup(narrow.select("fp", "n", "root").distinct(), joined, ["fp"]).withColumn("b", F.coalesce("b", "fp"))
    left = materialise(left, "partners")
    large = materialise(left.groupBy("b").agg(pieces.alias("k")).where("k > 1"), "large")
    left = lookup(left, large, ["b"]).withColumn("k", F.coalesce("k", F.lit(1)))
    sets = materialise(_texts(left.select("fp"), prints, docs).mapInArrow(tidy(_sets), "fp long, sim long, set binary"), "sets")
    met = _met(left, sets)
    more = materialise(met.mapInArrow(tidy(_forests), "u long, v long").distinct(), "forests")
    roots = materialise(components(edges.unionByName(more)), "roots").withColumnRenamed("node", "fp")
    rooted = materialise(lookup(nodes.select("fp", "low"), roots, ["fp"]).withColumn("root", F.coalesce("root", "fp")), "rooted")
    whole = rooted.groupBy("root").agg(F.min("low").alias("first"))
    named = materialise(rooted.join(whole, "root").select("fp", "first"), "classes")
    rows = prints.select("doc_id", "mark", "fp").join(named.hint("merge"), "fp")
    return rows.select("doc_id", hexed("fp").alias("fingerprint"), F.col("first.doc_id").alias("component_id"), "mark", "first")


def near_deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, with one of each class: a row of the doc_id and text that name it (the first by source, then lang, of repeated ones)."""
    return first_of(docs, near_copies(docs, **how))
