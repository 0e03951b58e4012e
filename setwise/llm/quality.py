"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines and repeated 3-word windows. The corpus rule hashes
every normalised line, counts in how many distinct documents of a host (the source) it stands, and removes lines above
the host's limit; a document whose own words are mostly gone then is rejected. Each copy of a text is a document and
counts. Of the texts that hold a frequent line, the one with the smallest digest (all its copies) keeps it, so that the
line rule never takes the last text that says something. The limit is LINE_DOCS documents, and LINE_SHARE of a host's
documents where that is more: a host that grows by more of the same keeps the same lines.

Defined results: null, empty and blank texts have no words and fail the base rules; a null source is a host of its own;
repeated rows each get a row, and rows of one host that repeat doc_id and text count as one document, as do those of one
text without a doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setwise.llm.common import SPACE, WORD, lookup, materialise, squash, table, text_key, unused, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50
#: A line is frequent in a host above LINE_DOCS documents and above LINE_SHARE of the host's documents.
LINE_DOCS, LINE_SHARE = 20, 0.02
#: A document is depleted if over this share of its words stands in removed lines.
DEPLETED = 0.5


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column, width: int) -> Column:
    """Words in windows (an array of hashes, one for each start) that occur twice or more."""

    def of(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        flagged = F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"]))
        starts = F.sort_array(F.filter(flagged, lambda p: p.isNotNull()))
        step = lambda a, p: F.struct((a["n"] + p + width - F.greatest(a["end"], p)).alias("n"), (p + width).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(placed, of))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) with the base counts instead of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = docs.select("doc_id", "source", text_key(F.col("text")).alias("key"), text.alias("text"), words_of(text).alias("w"), lines.alias("lines"))
    w = F.col("w")
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    rows = rows.withColumn("g", F.when(F.size(w) >= 4, hashes))
    gone = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    return rows.select(
        "doc_id", "source", "key",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        gone.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("g"), 3), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _host(source: Column) -> Column:
    return F.xxhash64(source, source.isNull())


def removed_words(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host, key (a text's digest), words (in all its lines), removed (in frequent lines); only texts that lose words."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    found = docs.select("doc_id", _host(F.col("source")).alias("host"), text_key(F.col("text")).alias("key"), F.col("text"))
    # Documents of a text: few texts have several, and a line's documents are its texts and what these have beyond one.
    texts = found.groupBy("host", "key").agg((F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("docs"))
    texts = materialise(texts, "texts")
    limits = materialise(texts.groupBy("host").agg(F.greatest(F.lit(float(line_docs)), F.sum("docs") * F.lit(line_share)).alias("most")), "limits")
    copied = materialise(texts.where("docs > 1").select("host", "key", (F.col("docs") - 1).alias("more")), "copied")
    found = found.select("host", "key", F.explode(lines).alias("line"))
    found = found.withColumn("words", F.regexp_count("line", F.lit(WORD))).where("words > 0")
    found = found.select("host", "key", F.xxhash64(squash(F.col("line"))).alias("line"), "words")
    # Copies of a text multiply both sums alike, so that shares of words stay what they are in one copy.
    each = materialise(found.groupBy("host", "line", "key").agg(F.sum("words").alias("words")), "lines")
    each_docs = lookup(each.select("host", "line", "key"), copied, ["host", "key"])
    often = each_docs.groupBy("host", "line").agg((F.count("*") + F.coalesce(F.sum("more"), F.lit(0))).alias("docs"), F.count("*").alias("texts"), F.min("key").alias("keeper"))
    often = often.where((F.col("docs") > line_docs) & (F.col("texts") > 1))  # a line of one text is its keeper's
    often = materialise(lookup(often, limits, ["host"], "inner").where("docs > most").select("host", "line", "keeper"), "frequent")
    lost = lookup(each, often, ["host", "line"], "inner").where("key <> keeper").groupBy("host", "key").agg(F.sum("words").alias("removed"))
    lost = materialise(lost, "lost")
    whole = lookup(each, lost.select("host", "key"), ["host", "key"], "inner").groupBy("host", "key").agg(F.sum("words").alias("words"))
    return whole.join(lost, ["host", "key"])


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """doc_id, source and key of each row of docs with its counts, base_failed, removed_share and kept."""
    lost = removed_words(docs, line_docs, line_share).select("host", "key", (F.col("removed") / F.col("words")).alias("removed_share"))
    lost = materialise(lost.where(F.col("removed_share") > depleted), "depleted")
    rows = base_counts(docs).withColumn("host", _host(F.col("source")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    rows = lookup(rows, lost, ["host", "key"])
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("removed_share").isNull())


def good_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    host, key = unused(docs, "host", "key")
    bad = judge(docs, **how).where("not kept").select(F.col("host").alias(host), F.col("key").alias(key)).distinct()
    rows = docs.withColumns({host: _host(F.col("source")), key: text_key(F.col("text"))})
    return lookup(rows, materialise(bad, "rejected"), [host, key], "left_anti").select(*docs.columns)


def op4(spark, sf_dir) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents")).select(*cols)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source IS NULL AS ns, coalesce(source, '') AS src FROM documents),
w AS (SELECT DISTINCT text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l FROM d),
g AS (SELECT text, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT text, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT text, i FROM (SELECT text, i, count(*) OVER (PARTITION BY text, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT text, count(*) AS n FROM (SELECT DISTINCT text, i + k AS p FROM r, (VALUES (0), (1), (2)) v(k)) GROUP BY text),
base AS (SELECT text, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines FROM w),
ls AS (SELECT t.ns, t.src, t.text, lower(trim(regexp_replace(ln, '[\x20\x09-\x0D]+', ' ', 'g'))) AS ln, len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) AS k
    FROM (SELECT ns, src, text, unnest(string_split(text, chr(10))) AS ln FROM (SELECT DISTINCT ns, src, text FROM d)) t WHERE regexp_matches(ln, '[^\x20\x09-\x0D]')),
each_line AS (SELECT ns, src, text, ln, sum(k) AS k FROM ls GROUP BY ALL),
texts AS (SELECT ns, src, text, sum(k) AS k FROM each_line GROUP BY ALL),
copies AS (SELECT ns, src, text, count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) AS docs FROM d GROUP BY ns, src, text),
hosts AS (SELECT ns, src, greatest(20, sum(docs) * 0.02) AS most FROM copies GROUP BY ALL),
often AS (SELECT ns, src, ln, min(md5(text)) AS keeper FROM each_line JOIN copies USING (ns, src, text) JOIN hosts USING (ns, src) GROUP BY ns, src, ln, most HAVING sum(docs) > most),
lost AS (SELECT ns, src, text, sum(k) AS k FROM each_line JOIN often USING (ns, src, ln) WHERE md5(text) <> keeper GROUP BY ns, src, text),
gone AS (SELECT t.ns, t.src, t.text FROM texts t JOIN lost USING (ns, src, text) WHERE lost.k / t.k > 0.5)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words) AND gone.text IS NULL AS kept
FROM d JOIN base USING (text) LEFT JOIN rep USING (text) LEFT JOIN gone USING (ns, src, text)
"""
