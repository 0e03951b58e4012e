"""SimHash near-dedup with pivot distance tables.

A fingerprint has a bit set where over half the XXH64 values of a text's 4-word shingles have it set. Fingerprints link
at `radius` or fewer differing bits; a document's component is the smallest doc_id that links reach.

How pairs are found, exactly and without a cross join: equal fingerprints are one representative. The 64 bits are cut
into 6 to 8 blocks; two fingerprints within the radius agree on all but `radius` of them, so each is dealt to one
bucket for every choice of that many blocks. A bucket of over HOT fingerprints is dealt again by one of
radius + 1 parts of the bits it does not share yet, as often as needed: nothing is lost, and no task holds a hot bucket.
Within a bucket, each fingerprint has a row of Hamming distances to PIVOTS reference fingerprints; a pair whose rows
differ by more than the radius anywhere is discarded (triangle inequality), and the survivors are verified. A
partition hands on a spanning star of what it linked, not the pairs. Components over all partitions come from
alternating large-star and small-star steps on written tables.

Defined results: null, empty and blank texts have no words and fingerprint zero, and link like any other; fewer than 4
words make one shingle; a null doc_id never names a component unless all in it are null; rows that share a doc_id or
have none are told apart by their texts; repeated rows each get a row, and near_deduplicated keeps one of them;
an empty table gives an empty result; other columns are kept by near_deduplicated and ignored by op9.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setwise.llm.common import LOWER, UPPER, lookup, materialise, table, text_key, unused

WIDTH, SEED, RADIUS = 4, 42, 4
PIVOTS, HOT = 16, 20_000
#: Blocks the bits are cut into, up to so many distinct fingerprints: keys of 21, 27 and 32 bits keep buckets small. The result is the same with any.
BLOCKS = ((6, 1 << 26), (7, 1 << 32), (8, 1 << 64))
#: Groups of at most SMALL fingerprints are compared by offsets, all groups at once; larger ones by breadth-first search.
SMALL = 12
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at ASCII space, 0x09 to 0x0D
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    starts = [0, *ends[: n - 1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[len(words) - n :])]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a long text in parts
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text: mark (a text's digest) tells rows apart that share a doc_id or have none."""
    return docs.select("doc_id", text_key(F.col("text")).alias("mark"), "text")


def lowest() -> Column:
    """The row that names a class: the smallest doc_id, null last, and of its texts the one with the smallest mark."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark, fp (the fingerprint's bits as a signed long) for each row."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(x.as_py(), width) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "mark", "fp"])

    return marked(docs).mapInArrow(run, "doc_id long, mark binary, fp long")


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius blocks, the bits in them."""
    one = [((1 << n) - 1) << a for a, n in _blocks(blocks)]
    return [sum(x) for x in itertools.combinations(one, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """One row for each fingerprint and bucket: mask (the bits that the bucket's members share) and fp."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in _masks(blocks, radius)])
    return fps.select("fp", F.explode(masks).alias("mask"))


def _split_masks(mask: int, radius: int) -> list[int]:
    """mask with each of radius + 1 parts of its unset bits: members of a bucket within the radius agree on one of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _finer(radius: int):
    def run(batches):
        for batch in batches:
            pairs = [(m, _signed(x)) for m in batch.column(0).to_pylist() for x in _split_masks(m & (1 << 64) - 1, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["mask", "finer"])

    return run


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that the links a-b reach from each of n."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def links(fp: np.ndarray, group: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked pairs of fp within equal, adjacent groups: enough to connect what the radius connects."""
    n = len(fp)
    near = np.empty((n, len(pivots)), np.int8)  # the pivot distance table
    for k, p in enumerate(pivots):
        near[:, k] = popcount(fp ^ p)

    def verified(i, j):
        for cols in (slice(0, 4), slice(4, None)):
            live = (np.abs(near[i, cols] - near[j, cols]) <= radius).all(1)
            i, j = i[live], j[live]
        live = popcount(fp[i] ^ fp[j]) <= radius
        return i[live], j[live]

    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    of = np.repeat(size, size)
    found = []
    for k in range(1, SMALL):
        i = np.flatnonzero((of[k:] <= SMALL) & (group[k:] == group[:-k])) if n > k else np.zeros(0, int)
        if not len(i):
            break
        found.append(verified(i, i + k))
    for a, m in zip(first[size > SMALL], size[size > SMALL]):
        left = np.arange(a, a + m)
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                i, j = verified(np.full(len(left), queue.pop()), left)
                if len(j):
                    found.append((i, j))
                    queue.extend(j)
                    left = np.setdiff1d(left, j, assume_unique=True)
    return tuple(np.concatenate(x) if found else np.zeros(0, int) for x in (zip(*found) if found else ((), ())))


def _stars(radius: int):
    def run(batches):
        """Rows come sorted by mask, bucket: a spanning star for each component found in a stretch of whole buckets."""
        pivots, held = pivot_fingerprints(), []

        def flush(rows):
            mask, key, fp = (np.concatenate(x) for x in zip(*rows))
            new = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])] if len(fp) else np.zeros(0, bool)
            unsigned = fp.view(np.uint64)
            a, b = links(unsigned, np.cumsum(new), radius, pivots)
            values, at = np.unique(unsigned, return_inverse=True)
            root = _roots(len(values), at[a], at[b])
            tied = np.flatnonzero(root != np.arange(len(values)))
            return pa.RecordBatch.from_arrays([pa.array(values[tied].view(np.int64)), pa.array(values[root[tied]].view(np.int64))], names=["u", "v"])

        for batch in batches:
            mask, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(fp):
                continue
            key = fp & mask
            held.append((mask, key, fp))
            if sum(len(x[0]) for x in held) >= 200_000:
                mask, key, fp = (np.concatenate(x) for x in zip(*held))
                last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
                cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on
                if cut:
                    yield flush([(mask[:cut], key[:cut], fp[:cut])])
                held = [(mask[cut:], key[cut:], fp[cut:])]
        if held:
            yield flush(held)

    return run


def linked(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, hot: int = HOT) -> DataFrame:
    """u, v: links between distinct fingerprints fps (fp) that connect all that `radius` connects."""
    n = fps.count()
    blocks = blocks or max(radius + 2, next(b for b, most in BLOCKS if n <= most))
    todo, edges = _dealt(fps, blocks, radius), None
    while True:
        keyed = todo.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("mask", "key")
        large = materialise(large, "hot")
        n_hot = large.count()
        cool = lookup(keyed, large, ["mask", "key"], "left_anti") if n_hot else keyed
        parts = cool.select("mask", "fp", "key").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").select("mask", "fp")
        got = materialise(parts.mapInArrow(_stars(radius), "u long, v long").distinct(), "links")
        edges = got if edges is None else edges.unionByName(got)
        if not n_hot:
            return edges
        finer = materialise(large.select("mask").distinct().mapInArrow(_finer(radius), "mask long, finer long"), "finer")
        back = lookup(keyed, large, ["mask", "key"], "left_semi")
        todo = materialise(lookup(back, finer, ["mask"], "inner").select("fp", F.col("finer").alias("mask")).distinct(), "dealt")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for every node of edges (u, v) that is not itself its root.

    Large-star links each larger neighbour of a node to the smallest; small-star links each smaller one. Both together
    end in stars; a hub's rows are joined to one minimum, so that Spark can split them."""
    stars = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def settle(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low, "u")

    state = None
    while True:  # ends for any graph, after a number of rounds that grows with the logarithm of its size
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        got = settle(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = got.distinct()
        small = settle(large).select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        small = small.select("u", "v").where("u <> v").unionByName(small.select(F.col("w").alias("u"), "v"))
        stars = materialise(small.distinct(), "stars")
        seen = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def classes(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints (doc_id, mark, fp), and fp, first (as lowest gives it) for each fingerprint that several rows share or a link reaches."""
    prints = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(lowest().alias("low"), F.count("*").alias("n")), "distinct")
    roots = components(linked(distinct.select("fp"), radius))
    rooted = lookup(distinct, roots.withColumnRenamed("node", "fp"), ["fp"]).withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "roots")
    whole = rooted.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("k"))
    named = rooted.join(whole, "root").where("n > 1 or k > 1").select("fp", "first")
    return prints, materialise(named, "classes")


def _rows(docs: DataFrame, radius: int, width: int) -> DataFrame:
    prints, named = classes(docs, radius, width)
    alone = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    return lookup(prints, named, ["fp"]).withColumn("first", F.coalesce("first", alone))


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text)."""
    return _rows(docs, radius, width).select("doc_id", hexed("fp").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def near_deduplicated(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """The rows of docs, all columns, with one of each component: a row of the doc_id and text that name it (the first by source, then lang, of repeated ones)."""
    return first_of(docs, _rows(docs, radius, width))


def first_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs with one of each class of found (doc_id, mark, first)."""
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    id_, none, mark, n, k = unused(docs, "id", "none", "mark", "n", "k")
    keep = keep.groupBy(F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(none), F.col("mark").alias(mark)).agg(F.count("*").alias(n))
    keep = materialise(keep, "kept")
    rows = docs.withColumns({id_: F.coalesce("doc_id", F.lit(0)), none: F.col("doc_id").isNull(), mark: text_key(F.col("text"))})
    rows = rows.join(keep.hint("merge"), [id_, none, mark])  # keep grows with docs: never broadcast
    rank = F.row_number().over(W.partitionBy(id_, none, mark).orderBy(*[c for c in docs.columns if c in ("source", "lang")], "text"))
    some = rows.where(F.col(n) > 1).withColumn(k, rank).where(F.col(k) == 1)
    return rows.where(F.col(n) == 1).select(*docs.columns).unionByName(some.select(*docs.columns))


def op9(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
