"""Line dedup by distinct-site spread.

Every line is hashed in normal form, and a HyperLogLog sketch of the sites (sources) it stands on is built for each
line hash; partial sketches merge by aggregation. Lines whose estimate is near the threshold get an exact distinct
count. Lines on `sites` sites or more are boilerplate across sites, and go from every text but the line's first one
(the text with the smallest digest), so that copies of a passage keep one.

Defined results: a null text stays null and has no lines; blank lines are never counted or removed; a null source is
a site of its own; repeated rows each get a row; a text that loses every line becomes empty; an empty table gives an
empty result; other columns are kept as they are by clean_documents and ignored by op6. Text between kept lines is
unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setwise.llm.common import WORD, lookup, materialise, squash, table, text_key, unused

#: A line on so many distinct sites is boilerplate.
SITES = 8
#: The sketch has 2**LG_K registers; estimates within NEAR (over six standard errors) of the threshold are counted exactly.
LG_K, NEAR = 12, 0.15


def boilerplate(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """line, keeper of the lines (site, line, key) that stand on `sites` distinct sites or more."""
    drawn = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("key").alias("keeper"))
    spread = materialise(drawn.select("line", "keeper", F.hll_sketch_estimate("sketch").alias("spread")).where(F.col("spread") >= sites * (1 - near)), "spread")
    far = spread.where(F.col("spread") > sites * (1 + near)).select("line", "keeper")
    close = spread.where(F.col("spread") <= sites * (1 + near)).select("line", "keeper")
    pairs = lookup(lines.select("line", "site"), close, ["line"], "inner").groupBy("line", "site").agg(F.min("keeper").alias("keeper"))
    exact = pairs.groupBy("line").agg(F.count("*").alias("n"), F.min("keeper").alias("keeper")).where(F.col("n") >= sites).select("line", "keeper")
    return far.unionByName(exact)


def removals(docs: DataFrame, sites: int = SITES, **how) -> DataFrame:
    """key (a text's digest) and the places, from 0 and ascending, of the lines that go; only texts that lose lines."""
    broken = F.split(F.col("text"), "\n")
    lines = docs.select(F.xxhash64(F.col("source"), F.col("source").isNull()).alias("site"), text_key(F.col("text")).alias("key"), F.posexplode(broken).alias("pos", "line"))
    lines = lines.where(F.rlike("line", F.lit(WORD))).select("site", "key", "pos", F.xxhash64(squash(F.col("line"))).alias("line"))
    lines = materialise(lines, "lines")
    bad = materialise(boilerplate(lines, sites, **how), "boilerplate")
    hit = lookup(lines, bad, ["line"], "inner").where("key <> keeper").groupBy("key", "pos").agg(F.count("*").alias("n"))
    return materialise(hit.groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "removals")


def clean_documents(docs: DataFrame, sites: int = SITES, keep_counts: bool = False, **how) -> DataFrame:
    """docs with the boilerplate lines gone from text; n_chars, if there, counts the new text. keep_counts adds n_lines (before) and n_removed."""
    key, lines = unused(docs, "key", "lines")
    gone = unused(docs, "gone")[0]
    lost = removals(docs.select("text", "source"), sites, **how).withColumnsRenamed({"key": key, "gone": gone})
    rows = lookup(docs.withColumn(key, text_key(F.col("text"))), lost, [key], width=F.size(gone) * 4 + 48).withColumn(lines, F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    joined = F.array_join(F.transform(kept, lambda i: F.col(lines)[i]), "\n")
    cut = F.col(gone).isNotNull()
    new = {"text": F.when(cut, joined).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(joined).cast("long")).otherwise(F.col("n_chars"))
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.when(cut, F.size(gone)).otherwise(0).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else c for c in docs.columns], *[v.alias(c) for c, v in counts.items() if keep_counts])


def op6(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return clean_documents(docs, keep_counts=True).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = r"""
WITH t AS (SELECT DISTINCT text, source IS NULL AS ns, coalesce(source, '') AS src FROM documents WHERE text IS NOT NULL),
l AS (SELECT text, ns, src, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM t),
n AS (SELECT text, ns, src, pos, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS ln FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
bad AS (SELECT ln, min(md5(text)) AS keeper FROM n GROUP BY ln HAVING count(DISTINCT (ns, src)) >= 8),
gone AS (SELECT DISTINCT text, pos FROM n JOIN bad USING (ln) WHERE md5(text) <> keeper),
kept AS (SELECT text, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE g IS NULL) AS kept, count(g) AS n_removed, count(*) AS n_lines
  FROM (SELECT DISTINCT l.text, l.pos, l.raw, g.pos AS g FROM l LEFT JOIN gone g ON l.text = g.text AND l.pos = g.pos) GROUP BY text)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept USING (text)
"""
