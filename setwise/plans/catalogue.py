"""The queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setwise.functions.integers import order_key_of_double, signed32, unsigned64_key
from setwise.operators import algebra as A
from setwise.operators import bitset as BITS
from setwise.operators import indexes as I
from setwise.operators import layout as L
from setwise.operators import longs as U64
from setwise.operators import order as O
from setwise.operators import statistics as S
from setwise.sources import sets as SRC

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

#: Views that the SQL of the queries shares.
PRIO = "B AS (SELECT DISTINCT o_orderpriority AS set_id, o_custkey AS v FROM orders)"
PAIR = PRIO + ", a AS (SELECT v FROM B WHERE set_id = '1-URGENT'), b2 AS (SELECT v FROM B WHERE set_id = '2-HIGH')"
IDX = "I AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS val FROM orders)"
FOUND = "found AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')"
RANKS = "R AS (SELECT set_id, v, row_number() OVER (PARTITION BY set_id ORDER BY v) AS rank FROM B)"
RUNS = "G AS (SELECT set_id, v, v - row_number() OVER (PARTITION BY set_id ORDER BY v) AS g FROM B), runs AS (SELECT set_id, min(v) AS lo, max(v) AS hi FROM G GROUP BY set_id, g)"


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(name: str, f: Callable, sql: str | None, views: str = ""):
    _QUERIES[name] = f
    if sql:
        _SQL[name] = f"WITH {views} {sql}" if views else sql


def read(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def prio(spark, d) -> DataFrame:
    return A.make(read(spark, d, "orders").select(F.col("o_orderpriority").alias("set_id"), F.col("o_custkey").alias("v")), "set_id", "v")


def one(spark, d, name) -> DataFrame:
    return prio(spark, d).where(F.col("set_id") == name).select("v")


def first(s, d):
    return one(s, d, "1-URGENT")


def second(s, d):
    return one(s, d, "2-HIGH")


def flags(spark, d) -> DataFrame:
    return A.make(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("set_id"), F.col("l_orderkey").alias("v")), "set_id", "v")


FLAG = "B AS (SELECT DISTINCT l_returnflag AS set_id, l_orderkey AS v FROM lineitem)"


def prices(spark, d, key="col_id") -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias(key), F.round(F.col("o_totalprice") * 100).cast("long").alias("val"))


def found(spark, d, key="col_id") -> DataFrame:
    return read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias(key)).distinct()


def sizes(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("col_id"), F.col("p_size").cast("long").alias("val"))


# Construction, mutation
query("set_make", lambda s, d: prio(s, d), "SELECT set_id, v FROM B", PRIO)
query("set_range", lambda s, d: A.value_range(s, 100, 5000), "SELECT range AS v FROM range(100, 5000)")
query("set_shift", lambda s, d: A.shift(prio(s, d), -500), "SELECT set_id, v - 500 AS v FROM B WHERE v - 500 BETWEEN 0 AND 4294967295", PRIO)
query("set_shift_up", lambda s, d: A.shift(prio(s, d), 4294967000), "SELECT set_id, v + 4294967000 AS v FROM B WHERE v + 4294967000 BETWEEN 0 AND 4294967295", PRIO)
query("set_add", lambda s, d: A.add(first(s, d), 123456), "SELECT v FROM a UNION SELECT 123456", PAIR)
query("set_remove", lambda s, d: A.remove(first(s, d), 7), "SELECT v FROM a WHERE v <> 7", PAIR)
query("set_flip", lambda s, d: A.flip(first(s, d), 7), "(SELECT v FROM a WHERE v <> 7) UNION ALL (SELECT 7 WHERE 7 NOT IN (SELECT v FROM a))", PAIR)
query("set_add_range", lambda s, d: A.add_range(first(s, d), 50, 900), "SELECT v FROM a UNION SELECT range FROM range(50, 900)", PAIR)
query("set_remove_range", lambda s, d: A.remove_range(prio(s, d), 50, 900), "SELECT set_id, v FROM B WHERE NOT (v >= 50 AND v < 900)", PRIO)
query("set_flip_range", lambda s, d: A.flip_range(first(s, d), 50, 900), "(SELECT v FROM a WHERE v < 50 OR v >= 900) UNION ALL (SELECT range FROM range(50, 900) WHERE range NOT IN (SELECT v FROM a))", PAIR)
query("set_select_range", lambda s, d: A.select_range(prio(s, d), 50, 900), "SELECT set_id, v FROM B WHERE v >= 50 AND v < 900", PRIO)
query("set_checked_add", lambda s, d: A.checked_add(first(s, d), second(s, d)), "SELECT v, v NOT IN (SELECT v FROM a) AS changed FROM b2", PAIR)
query("set_checked_remove", lambda s, d: A.checked_remove(first(s, d), second(s, d)), "SELECT v, v IN (SELECT v FROM a) AS changed FROM b2", PAIR)

# Predicates
query("set_contains", lambda s, d: A.intersects_range(first(s, d), 7, 8), "SELECT count(*) > 0 AS intersects FROM a WHERE v = 7", PAIR)
query("set_contains_range", lambda s, d: A.contains_range(A.wide_or(prio(s, d)), 10, 60), "SELECT count(DISTINCT v) = 50 AS contains FROM B WHERE v >= 10 AND v < 60", PRIO)
query("set_contains_empty_range", lambda s, d: A.contains_range(first(s, d), 60, 60), "SELECT count(*) > 0 AND 60 < 60 AS contains FROM a WHERE v >= 60 AND v < 60", PAIR)
query("set_contains_set", lambda s, d: A.contains_set(first(s, d), A.wide_and(prio(s, d))), "SELECT count(*) = 0 AS contains FROM (SELECT v FROM B GROUP BY v HAVING count(*) = (SELECT count(DISTINCT set_id) FROM B) EXCEPT SELECT v FROM a)", PAIR)
query("set_intersects", lambda s, d: A.intersects(first(s, d), second(s, d)), "SELECT count(*) > 0 AS intersects FROM a JOIN b2 USING (v)", PAIR)
query("set_intersects_range", lambda s, d: A.intersects_range(first(s, d), 20, 30), "SELECT count(*) > 0 AS intersects FROM a WHERE v >= 20 AND v < 30", PAIR)
query("set_equal", lambda s, d: A.equal(first(s, d), second(s, d)), "SELECT count(*) = 0 AS equal FROM (SELECT v FROM (SELECT v FROM a UNION ALL SELECT v FROM b2) GROUP BY v HAVING count(*) = 1)", PAIR)
query("set_exceeds", lambda s, d: A.exceeds(first(s, d), 100), "SELECT count(*) > 100 AS exceeds FROM a", PAIR)

query("set_is_empty", lambda s, d: A.is_empty(A.select_range(first(s, d), 20, 30)), "SELECT count(*) = 0 AS empty FROM a WHERE v >= 20 AND v < 30", PAIR)
query("set_clear", lambda s, d: A.clear(first(s, d)), "SELECT v FROM a WHERE v < 0 AND v >= 0", PAIR)
query("equal_sets", lambda s, d: A.equal_sets(A.make(read(s, d, "lineitem").select(F.col("l_partkey").alias("set_id"), F.col("l_linenumber").cast("long").alias("v")), "set_id", "v")), "SELECT set_id, min(set_id) OVER (PARTITION BY vs) AS first FROM (SELECT l_partkey AS set_id, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS vs FROM lineitem GROUP BY l_partkey)")

# Pairs
query("set_and", lambda s, d: A.intersection(first(s, d), second(s, d)), "SELECT v FROM a INTERSECT SELECT v FROM b2", PAIR)
query("set_or", lambda s, d: A.union(first(s, d), second(s, d)), "SELECT v FROM a UNION SELECT v FROM b2", PAIR)
query("set_xor", lambda s, d: A.symmetric_difference(first(s, d), second(s, d)), "SELECT v FROM (SELECT v FROM a UNION ALL SELECT v FROM b2) GROUP BY v HAVING count(*) = 1", PAIR)
query("set_andnot", lambda s, d: A.difference(first(s, d), second(s, d)), "SELECT v FROM a EXCEPT SELECT v FROM b2", PAIR)
query("set_ornot", lambda s, d: A.or_not(first(s, d), second(s, d), 700), "SELECT v FROM a UNION (SELECT range FROM range(0, 700) WHERE range NOT IN (SELECT v FROM b2))", PAIR)
query("set_andnot_range", lambda s, d: A.difference(A.select_range(first(s, d), 100, 800), second(s, d)), "SELECT v FROM a WHERE v >= 100 AND v < 800 EXCEPT SELECT v FROM b2", PAIR)
query("card_pair", lambda s, d: A.cardinalities(first(s, d), second(s, d)), "SELECT count(a.v) FILTER (WHERE b2.v IS NOT NULL) AS and_card, count(*) AS or_card, count(*) FILTER (WHERE a.v IS NULL OR b2.v IS NULL) AS xor_card, count(a.v) FILTER (WHERE b2.v IS NULL) AS andnot_card FROM a FULL JOIN b2 ON a.v = b2.v", PAIR)
query("card_set", lambda s, d: prio(s, d).groupBy("set_id").agg(F.count("*").alias("card")), "SELECT set_id, count(*) AS card FROM B GROUP BY set_id", PRIO)
query("card_range", lambda s, d: A.select_range(prio(s, d), 100, 1000).groupBy("set_id").agg(F.count("*").alias("card")), "SELECT set_id, count(*) AS card FROM B WHERE v >= 100 AND v < 1000 GROUP BY set_id", PRIO)
query("pair_measures", lambda s, d: A.pair_measures(prio(s, d), 400), "SELECT x.set_id AS a, y.set_id AS b, ca.n + cb.n - 2 * count(*) AS hamming, ca.n + cb.n - 2 * count(*) <= 400 AS similar, count(*) = cb.n AS a_holds_b, count(*) = ca.n AS b_holds_a, count(*) / (ca.n + cb.n - count(*)) AS jaccard FROM B x JOIN B y ON x.v = y.v AND x.set_id < y.set_id JOIN c ca ON ca.set_id = x.set_id JOIN c cb ON cb.set_id = y.set_id GROUP BY x.set_id, y.set_id, ca.n, cb.n", PRIO + ", c AS (SELECT set_id, count(*) AS n FROM B GROUP BY set_id)")
query("pairwise_consecutive", lambda s, d: A.consecutive_pairs(prio(s, d)), "SELECT p.a, p.b, count(*) FILTER (WHERE k = 3) AS and_card, count(*) AS or_card, count(*) FILTER (WHERE k < 3) AS xor_card, count(*) FILTER (WHERE k = 1) AS andnot_card FROM (SELECT p.a, p.b, v, sum(CASE WHEN set_id = p.a THEN 1 ELSE 2 END) AS k FROM p JOIN B ON B.set_id IN (p.a, p.b) GROUP BY ALL) p GROUP BY p.a, p.b", PRIO + ", ids AS (SELECT DISTINCT set_id FROM B), p AS (SELECT * FROM (SELECT set_id AS a, lead(set_id) OVER (ORDER BY set_id) AS b FROM ids) WHERE b IS NOT NULL)")

# Wide aggregation
ALL = "(SELECT count(DISTINCT set_id) FROM B)"
query("wide_and", lambda s, d: A.wide_and(prio(s, d)), f"SELECT v FROM B GROUP BY v HAVING count(*) = {ALL}", PRIO)
query("wide_or", lambda s, d: A.wide_or(prio(s, d)), "SELECT DISTINCT v FROM B", PRIO)
query("wide_xor", lambda s, d: A.wide_xor(prio(s, d)), "SELECT v FROM B GROUP BY v HAVING count(*) % 2 = 1", PRIO)
query("wide_and_range", lambda s, d: A.wide_and(A.select_range(prio(s, d), 100, 900), A.n_sets(prio(s, d))), f"SELECT v FROM B WHERE v >= 100 AND v < 900 GROUP BY v HAVING count(*) = {ALL}", PRIO)
query("wide_or_range", lambda s, d: A.wide_or(A.select_range(prio(s, d), 100, 900)), "SELECT DISTINCT v FROM B WHERE v >= 100 AND v < 900", PRIO)
query("wide_xor_range", lambda s, d: A.wide_xor(A.select_range(prio(s, d), 100, 900)), "SELECT v FROM B WHERE v >= 100 AND v < 900 GROUP BY v HAVING count(*) % 2 = 1", PRIO)
query("wide_and_card", lambda s, d: A.wide_and(prio(s, d)).agg(F.count("*").alias("card")), f"SELECT count(*) AS card FROM (SELECT v FROM B GROUP BY v HAVING count(*) = {ALL})", PRIO)
query("wide_or_card", lambda s, d: prio(s, d).agg(F.countDistinct("v").alias("card")), "SELECT count(DISTINCT v) AS card FROM B", PRIO)
query("wide_intersects", lambda s, d: A.wide_and(prio(s, d)).limit(1).agg((F.count("*") > 0).alias("intersects")), f"SELECT count(*) > 0 AS intersects FROM (SELECT v FROM B GROUP BY v HAVING count(*) = {ALL})", PRIO)
query("wide_and_of_disjoint", lambda s, d: A.wide_and(A.make(read(s, d, "orders").select(F.col("o_orderstatus").alias("set_id"), F.col("o_orderkey").alias("v")), "set_id", "v")), "SELECT v FROM (SELECT DISTINCT o_orderstatus, o_orderkey AS v FROM orders) GROUP BY v HAVING count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
query("wide_and_words", lambda s, d: L.from_words(L.word_algebra(L.to_words(prio(s, d)), "and", A.n_sets(prio(s, d))).withColumn("set_id", F.lit(0))).select("v"), f"SELECT v FROM B GROUP BY v HAVING count(*) = {ALL}", PRIO)
query("wide_or_words", lambda s, d: L.from_words(L.word_algebra(L.to_words(prio(s, d)), "or").withColumn("set_id", F.lit(0))).select("v"), "SELECT DISTINCT v FROM B", PRIO)
query("wide_xor_words", lambda s, d: L.from_words(L.word_algebra(L.to_words(prio(s, d)), "xor").withColumn("set_id", F.lit(0))).select("v"), "SELECT v FROM B GROUP BY v HAVING count(*) % 2 = 1", PRIO)
query("words", lambda s, d: L.to_words(prio(s, d)).select("set_id", "w", F.bit_count("bits").cast("long").alias("n")), "SELECT set_id, v // 64 AS w, count(*) AS n FROM B GROUP BY ALL", PRIO)
query("packed_card", lambda s, d: L.packed_cardinality(L.to_packed(prio(s, d))), "SELECT set_id, count(*) AS card FROM B GROUP BY set_id", PRIO)
query("packed_or_card", lambda s, d: L.packed_cardinality(L.packed_union(L.to_packed(prio(s, d))).withColumn("set_id", F.lit(0))).select("card"), "SELECT count(DISTINCT v) AS card FROM B", PRIO)
query("packed_and_card", lambda s, d: L.packed_cardinality(L.packed_intersection(L.to_packed(prio(s, d)), A.n_sets(prio(s, d))).withColumn("set_id", F.lit(0))).select("card"), f"SELECT count(*) AS card FROM (SELECT v FROM B GROUP BY v HAVING count(*) = {ALL})", PRIO)
query("rollup_distinct", lambda s, d: A.rollup_cardinality(read(s, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("v")), "o_orderstatus", "o_orderpriority"), "SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS card FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")

# Order statistics, iteration
query("rank_all", lambda s, d: O.ranked(flags(s, d)), "SELECT set_id, v, rank FROM R", f"{FLAG}, {RANKS}")
query("rank_of", lambda s, d: O.rank_of(prio(s, d), 700), "SELECT set_id, count(*) FILTER (WHERE v <= 700) AS rank FROM B GROUP BY set_id", PRIO)
query("select_j", lambda s, d: O.select(flags(s, d), 50), "SELECT set_id, v FROM R WHERE rank = 51", f"{FLAG}, {RANKS}")
query("first_last", lambda s, d: O.ends(prio(s, d)), "SELECT set_id, min(v) AS first, max(v) AS last, min(v) AS first_signed, max(v) AS last_signed FROM B GROUP BY set_id", PRIO)
query("signed_ends", lambda s, d: O.ends(A.shift(prio(s, d), 2147483000)), "SELECT set_id, min(v) AS first, max(v) AS last, min(s) AS first_signed, max(s) AS last_signed FROM (SELECT set_id, v + 2147483000 AS v, CASE WHEN v + 2147483000 >= 2147483648 THEN v + 2147483000 - 4294967296 ELSE v + 2147483000 END AS s FROM B) GROUP BY set_id", PRIO)
query("signed_view", lambda s, d: A.shift(first(s, d), 2147483000).select("v", signed32(F.col("v")).alias("signed")), "SELECT v + 2147483000 AS v, CASE WHEN v + 2147483000 >= 2147483648 THEN v + 2147483000 - 4294967296 ELSE v + 2147483000 END AS signed FROM a", PAIR)
query("limit_k", lambda s, d: O.limit(flags(s, d), 40), "SELECT set_id, v FROM R WHERE rank <= 40", f"{FLAG}, {RANKS}")
query("page", lambda s, d: O.page(flags(s, d), 10, 3), "SELECT set_id, v FROM R WHERE (rank - 1) // 10 = 3", f"{FLAG}, {RANKS}")
query("next_previous", lambda s, d: O.neighbours(prio(s, d), 501), "SELECT set_id, coalesce(min(v) FILTER (WHERE v >= 501), -1) AS next_value, coalesce(max(v) FILTER (WHERE v <= 501), -1) AS previous_value FROM B GROUP BY set_id", PRIO)
query("absent_neighbours", lambda s, d: O.absent_neighbours(flags(s, d), 300), "SELECT set_id, coalesce(max(hi + 1) FILTER (WHERE lo <= 300 AND hi >= 300), 300) AS next_absent, coalesce(max(lo - 1) FILTER (WHERE lo <= 300 AND hi >= 300), 300) AS previous_absent FROM runs GROUP BY set_id", f"{FLAG}, {RUNS}")
query("runs", lambda s, d: O.runs(flags(s, d)), 'SELECT set_id, lo AS start, hi AS "end" FROM runs', f"{FLAG}, {RUNS}")
query("presence", lambda s, d: O.presence(first(s, d), 100, 600), "SELECT range - 100 AS position, range IN (SELECT v FROM a) AS present FROM range(100, 700)", PAIR)
query("presence_runs", lambda s, d: O.presence_runs(first(s, d), 100, 600), "SELECT first, last, present FROM (SELECT min(range) - 100 AS first, max(range) - 100 AS last, present FROM (SELECT range, present, range - row_number() OVER (PARTITION BY present ORDER BY range) AS g FROM (SELECT range, range IN (SELECT v FROM a) AS present FROM range(100, 700))) GROUP BY present, g)", PAIR)
query("present_positions", lambda s, d: O.present_positions(first(s, d), 100, 600), "SELECT v - 100 AS position FROM a WHERE v >= 100 AND v < 700", PAIR)
query("seek", lambda s, d: O.seek(flags(s, d), 700), "SELECT set_id, v FROM B WHERE v >= 700", FLAG)
query("peek", lambda s, d: O.peek(flags(s, d), 701), 'SELECT set_id, min(v) AS "next" FROM B WHERE v >= 701 GROUP BY set_id', FLAG)
query("chunk_sums", lambda s, d: O.chunk_sums(flags(s, d)), "SELECT set_id, chunk, card, CAST(coalesce(sum(card) OVER (PARTITION BY set_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, low, high FROM (SELECT set_id, v >> 16 AS chunk, count(*) AS card, min(v) AS low, max(v) AS high FROM B GROUP BY ALL)", FLAG)
query("as_of", lambda s, d: O.as_of(prio(s, d), read(s, d, "orders").select(F.col("o_orderpriority").alias("set_id"), F.col("o_orderkey").alias("x"))), "SELECT p.set_id, x, coalesce(n.v, -1) AS next_value, coalesce(l.v, -1) AS previous_value FROM p ASOF LEFT JOIN B n ON p.set_id = n.set_id AND p.x <= n.v ASOF LEFT JOIN B l ON p.set_id = l.set_id AND p.x >= l.v", PRIO + ", p AS (SELECT DISTINCT o_orderpriority AS set_id, o_orderkey AS x FROM orders)")
query("to_array", lambda s, d: SRC.to_text(prio(s, d)), "SELECT set_id, '{' || string_agg(v, ',' ORDER BY v) || '}' AS text FROM B GROUP BY set_id", PRIO)

# 64-bit order
WIDE = "V AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN o_orderkey * 1000003 ELSE -o_orderkey * 1000003 - 1 END AS v FROM orders)"


def wide_values(s, d) -> DataFrame:
    return read(s, d, "orders").select(F.expr("if(o_custkey % 2 = 0, o_orderkey * 1000003, -o_orderkey * 1000003 - 1)").alias("v")).distinct()


def other_values(s, d) -> DataFrame:
    return read(s, d, "orders").select((F.col("o_orderkey") * 1000003).alias("v")).distinct()


U = "R AS (SELECT v, row_number() OVER (ORDER BY v < 0, v) AS rank FROM V)"
W2 = WIDE + ", X AS (SELECT DISTINCT o_orderkey * 1000003 AS v FROM orders)"
HALF = 1 << 63
query("u64_rank", lambda s, d: U64.ranked(wide_values(s, d)), "SELECT v, rank FROM R", f"{WIDE}, {U}")
query("u64_rank_of", lambda s, d: U64.rank_of(wide_values(s, d), 50_000_000), "SELECT count(*) AS rank FROM V WHERE v BETWEEN 0 AND 50000000", WIDE)
query("u64_ends", lambda s, d: U64.ends(wide_values(s, d)), "SELECT (SELECT v FROM V ORDER BY v < 0, v LIMIT 1) AS first, (SELECT v FROM V ORDER BY v < 0 DESC, v DESC LIMIT 1) AS last", WIDE)
query("u64_select", lambda s, d: U64.select(wide_values(s, d), 100), "SELECT v FROM V ORDER BY v < 0, v LIMIT 1 OFFSET 100", WIDE)
query("u64_limit", lambda s, d: U64.limit(wide_values(s, d), 333), "SELECT v FROM R WHERE rank <= 333", f"{WIDE}, {U}")
query("u64_page", lambda s, d: U64.page(wide_values(s, d), 700, 100), "SELECT v, rank FROM R WHERE rank > 700 AND rank <= 800", f"{WIDE}, {U}")
query("u64_last", lambda s, d: U64.last(wide_values(s, d), 40), "SELECT v FROM V ORDER BY v < 0 DESC, v DESC LIMIT 40", WIDE)
query("u64_and", lambda s, d: A.intersection(wide_values(s, d), other_values(s, d)), "SELECT v FROM V INTERSECT SELECT v FROM X", W2)
query("u64_or", lambda s, d: A.union(wide_values(s, d), other_values(s, d)), "SELECT v FROM V UNION SELECT v FROM X", W2)
query("u64_xor", lambda s, d: A.symmetric_difference(wide_values(s, d), other_values(s, d)), "SELECT v FROM (SELECT v FROM V UNION ALL SELECT v FROM X) GROUP BY v HAVING count(*) = 1", W2)
query("u64_andnot", lambda s, d: A.difference(wide_values(s, d), other_values(s, d)), "SELECT v FROM V EXCEPT SELECT v FROM X", W2)
query("u64_intersects", lambda s, d: A.intersects(wide_values(s, d), other_values(s, d)), "SELECT count(*) > 0 AS intersects FROM V JOIN X USING (v)", W2)
query("u64_cards", lambda s, d: A.cardinalities(wide_values(s, d), other_values(s, d)), "SELECT count(V.v) FILTER (WHERE X.v IS NOT NULL) AS and_card, count(*) AS or_card, count(*) FILTER (WHERE V.v IS NULL OR X.v IS NULL) AS xor_card, count(V.v) FILTER (WHERE X.v IS NULL) AS andnot_card FROM V FULL JOIN X ON V.v = X.v", W2)
query("u64_equal", lambda s, d: A.equal(wide_values(s, d), other_values(s, d)), "SELECT count(*) = 0 AS equal FROM (SELECT v FROM (SELECT v FROM V UNION ALL SELECT v FROM X) GROUP BY v HAVING count(*) = 1)", W2)
query("u64_card", lambda s, d: U64.cardinality(wide_values(s, d)), "SELECT count(*) AS card FROM V", WIDE)
query("u64_int_card", lambda s, d: U64.int_cardinality(wide_values(s, d)), "SELECT CAST(count(*) AS INTEGER) AS card FROM V", WIDE)
query("u64_add", lambda s, d: U64.add(wide_values(s, d), (1 << 64) - 5), "SELECT v FROM V UNION SELECT -5", WIDE)
query("u64_remove", lambda s, d: U64.remove(wide_values(s, d), -1), "SELECT v FROM V WHERE v <> -1", WIDE)
query("u64_flip", lambda s, d: U64.flip(wide_values(s, d), -1), "(SELECT v FROM V WHERE v <> -1) UNION ALL (SELECT -1 WHERE -1 NOT IN (SELECT v FROM V))", WIDE)
query("u64_contains", lambda s, d: U64.contains(wide_values(s, d), -1), "SELECT count(*) > 0 AS contains FROM V WHERE v = -1", WIDE)
query("u64_select_range", lambda s, d: U64.select_range(wide_values(s, d), 30_000_000, 1 << 64), "SELECT v FROM V WHERE v >= 30000000 OR v < 0", WIDE)
query("u64_add_range", lambda s, d: U64.add_range(wide_values(s, d), HALF - 300, HALF + 300), "SELECT v FROM V UNION SELECT 9223372036854775807 - range FROM range(0, 300) UNION SELECT -9223372036854775808 + range FROM range(0, 300)", WIDE)
query("u64_remove_range", lambda s, d: U64.remove_range(wide_values(s, d), 40_000_000, HALF), "SELECT v FROM V WHERE v < 40000000", WIDE)
query("u64_flip_range", lambda s, d: U64.flip_range(wide_values(s, d), 1_999_900, 2_000_100), "(SELECT v FROM V WHERE NOT (v >= 1999900 AND v < 2000100)) UNION ALL (SELECT range FROM range(1999900, 2000100) WHERE range NOT IN (SELECT v FROM V))", WIDE)
query("u64_presence_runs", lambda s, d: U64.presence_runs(wide_values(s, d), 1_999_900, 1_999_900 + 60_000), "SELECT min(range) AS first, max(range) AS last, present FROM (SELECT range, present, range - row_number() OVER (PARTITION BY present ORDER BY range) AS g FROM (SELECT range, range IN (SELECT v FROM V) AS present FROM range(1999900, 2059900))) GROUP BY present, g, CASE WHEN present THEN range >> 16 END", WIDE)
query("u64_portable", lambda s, d: SRC.decode(SRC.encode(wide_values(s, d).withColumn("set_id", F.lit("all")), "portable64"), "portable64"), "SELECT 'all' AS set_id, v FROM V", WIDE)
query("u64_legacy", lambda s, d: SRC.decode(SRC.encode(wide_values(s, d).withColumn("set_id", F.lit("all")), "legacy64"), "legacy64"), "SELECT 'all' AS set_id, v FROM V", WIDE)
query("double_order", lambda s, d: read(s, d, "customer").select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy(unsigned64_key(order_key_of_double(F.col("c_acctbal"))), "c_custkey")).cast("long").alias("rank")), "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank FROM customer")

# Range index
def parts_index(s, d) -> DataFrame:
    return sizes(s, d).withColumnRenamed("col_id", "rid")


CONTEXT = "C AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R')"


def returned(s, d, key="rid") -> DataFrame:
    return read(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias(key)).distinct()


for _op, _sign in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">="), ("eq", "="), ("neq", "<>")):
    query(f"range_{_op}", lambda s, d, op=_op: I.compare(prices(s, d, "rid"), op, 15_000_000), f"SELECT id AS rid FROM I WHERE val {_sign} 15000000", IDX)
    query(f"range_{_op}_context", lambda s, d, op=_op: I.compare(prices(s, d, "rid"), op, 15_000_000, found(s, d, "rid")), f"SELECT id AS rid FROM I WHERE val {_sign} 15000000 AND id IN (SELECT id FROM found)", f"{IDX}, {FOUND}")
    query(f"range_{_op}_card", lambda s, d, op=_op: I.compare(prices(s, d, "rid"), op, 15_000_000).agg(F.count("*").alias("card")), f"SELECT count(*) AS card FROM I WHERE val {_sign} 15000000", IDX)
    query(f"range_parts_{_op}", lambda s, d, op=_op: I.compare(parts_index(s, d), op, 25, returned(s, d)), f"SELECT p_partkey AS rid FROM part WHERE p_size {_sign} 25 AND p_partkey IN (SELECT id FROM C)", CONTEXT)
    query(f"range_{_op}_context_card", lambda s, d, op=_op: I.compare(parts_index(s, d), op, 25, returned(s, d)).agg(F.count("*").alias("card")), f"SELECT count(*) AS card FROM part WHERE p_size {_sign} 25 AND p_partkey IN (SELECT id FROM C)", CONTEXT)
    query(f"bsi_{_op}_found", lambda s, d, op=_op: I.compare(sizes(s, d), op, 25, returned(s, d, "col_id"), "col_id"), f"SELECT p_partkey AS col_id FROM part WHERE p_size {_sign} 25 AND p_partkey IN (SELECT id FROM C)", CONTEXT)
    query(f"bsi_{_op}", lambda s, d, op=_op: I.compare(sizes(s, d), op, 25, key="col_id"), f"SELECT p_partkey AS col_id FROM part WHERE p_size {_sign} 25")
query("range_unsigned_gt", lambda s, d: I.compare_unsigned(wide_values(s, d).select(F.col("v").alias("rid"), F.col("v").alias("val")), "gt", 5_000_015), "SELECT v AS rid FROM V WHERE v < 0 OR v > 5000015", WIDE)
query("range_unsigned_context", lambda s, d: I.compare_unsigned(wide_values(s, d).select(F.col("v").alias("rid"), F.col("v").alias("val")), "gt", 5_000_015, other_values(s, d).withColumnRenamed("v", "rid")), "SELECT v AS rid FROM V JOIN X USING (v) WHERE v < 0 OR v > 5000015", W2)
query("range_dense", lambda s, d: I.dense(prices(s, d, "rid")), "SELECT min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) AS dense FROM orders")
query("range_between", lambda s, d: I.between(prices(s, d, "rid"), 9_000_000, 15_000_000), "SELECT id AS rid FROM I WHERE val BETWEEN 9000000 AND 15000000", IDX)
query("range_between_context", lambda s, d: I.between(prices(s, d, "rid"), 9_000_000, 15_000_000, found(s, d, "rid")), "SELECT id AS rid FROM I WHERE val BETWEEN 9000000 AND 15000000 AND id IN (SELECT id FROM found)", f"{IDX}, {FOUND}")
query("range_between_card", lambda s, d: I.between(prices(s, d, "rid"), 9_000_000, 15_000_000).agg(F.count("*").alias("card")), "SELECT count(*) AS card FROM I WHERE val BETWEEN 9000000 AND 15000000", IDX)

# Bit-sliced index
query("bsi_range", lambda s, d: I.between(sizes(s, d), 10, 20, key="col_id"), "SELECT p_partkey AS col_id FROM part WHERE p_size BETWEEN 10 AND 20")
query("bsi_in", lambda s, d: I.is_in(sizes(s, d), read(s, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_quantity") * 3).cast("long").alias("val"))), "SELECT p_partkey AS col_id FROM part WHERE p_size IN (SELECT l_quantity * 3 FROM lineitem WHERE l_returnflag = 'R')")
query("bsi_in_found", lambda s, d: I.is_in(sizes(s, d), read(s, d, "lineitem").select((F.col("l_quantity") * 3).cast("long").alias("val")), returned(s, d, "col_id")), "SELECT p_partkey AS col_id FROM part WHERE p_size IN (SELECT l_quantity * 3 FROM lineitem) AND p_partkey IN (SELECT id FROM C)", CONTEXT)
query("bsi_sum", lambda s, d: I.total(prices(s, d), found(s, d)), "SELECT CAST(coalesce(sum(val), 0) AS BIGINT) AS total, count(*) AS n FROM found LEFT JOIN I USING (id)", f"{IDX}, {FOUND}")
query("bsi_sum_missing", lambda s, d: I.total(sizes(s, d), read(s, d, "orders").select(F.col("o_orderkey").alias("col_id")).distinct()), "SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total, count(*) AS n FROM (SELECT DISTINCT o_orderkey AS k FROM orders) LEFT JOIN part ON k = p_partkey")
query("bsi_sum_slices", lambda s, d: I.sliced_total(prices(s, d), 40), "SELECT CAST(sum(val) AS BIGINT) AS total FROM I", IDX)
query("bsi_topk", lambda s, d: I.top_k(sizes(s, d), 25), "SELECT p_partkey AS col_id FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 25")
query("bsi_topk_slices", lambda s, d: I.sliced_top_k(sizes(s, d), 25, 6), "SELECT p_partkey AS col_id FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 25")
query("bsi_transpose", lambda s, d: I.transpose(sizes(s, d)).select("val"), "SELECT DISTINCT CAST(p_size AS BIGINT) AS val FROM part")
query("bsi_transpose_count", lambda s, d: I.transpose(sizes(s, d)), "SELECT CAST(p_size AS BIGINT) AS val, count(*) AS n FROM part GROUP BY 1")
query("bsi_transpose_found", lambda s, d: I.transpose(sizes(s, d), returned(s, d, "col_id")), "SELECT CAST(p_size AS BIGINT) AS val, count(*) AS n FROM part WHERE p_partkey IN (SELECT id FROM C) GROUP BY 1", CONTEXT)
query("bsi_topk_found", lambda s, d: I.top_k(sizes(s, d), 25, returned(s, d, "col_id")), "SELECT p_partkey AS col_id FROM part WHERE p_partkey IN (SELECT id FROM C) ORDER BY p_size DESC, p_partkey DESC LIMIT 25", CONTEXT)
query("bsi_pairs_found", lambda s, d: I.pairs(sizes(s, d), returned(s, d, "col_id")), "SELECT p_partkey AS col_id, CAST(p_size AS BIGINT) AS val FROM part WHERE p_partkey IN (SELECT id FROM C)", CONTEXT)
query("bsi_add", lambda s, d: I.add(sizes(s, d), read(s, d, "lineitem").groupBy(F.col("l_partkey").alias("col_id")).agg(F.count("*").alias("val"))), "SELECT col_id, CAST(sum(val) AS BIGINT) AS val FROM (SELECT p_partkey AS col_id, p_size AS val FROM part UNION ALL SELECT l_partkey, count(*) FROM lineitem GROUP BY 1) GROUP BY col_id")
query("bsi_merge", lambda s, d: I.merge(sizes(s, d).where("val <= 25"), sizes(s, d).where("val > 25")), "SELECT p_partkey AS col_id, CAST(p_size AS BIGINT) AS val FROM part")
query("bsi_upsert", lambda s, d: I.upsert(sizes(s, d), read(s, d, "events").select(F.col("user_id").alias("col_id"), F.round(F.col("value") * 100).cast("long").alias("val"), F.col("event_id").alias("seq"))), "SELECT coalesce(user_id, p_partkey) AS col_id, coalesce(val, CAST(p_size AS BIGINT)) AS val FROM part FULL JOIN (SELECT user_id, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS val FROM events GROUP BY user_id) ON user_id = p_partkey")
query("bsi_get", lambda s, d: I.lookup(sizes(s, d), read(s, d, "orders").select(F.col("o_orderkey").alias("col_id"))), "SELECT o_orderkey AS col_id, CAST(coalesce(p_size, 0) AS BIGINT) AS val, p_size IS NOT NULL AS there FROM orders LEFT JOIN part ON o_orderkey = p_partkey")
query("bsi_slices", lambda s, d: I.slices(sizes(s, d), 6).groupBy("slice").agg(F.count("*").alias("n")), "SELECT CAST(i AS INTEGER) AS slice, count(*) AS n FROM part, range(0, 6) t(i) WHERE (p_size >> CAST(i AS INTEGER)) & 1 = 1 GROUP BY i")
query("bsi_compare_slices", lambda s, d: I.sliced_compare(sizes(s, d), 25, 6), "SELECT p_partkey AS col_id, CAST(sign(p_size - 25) AS INTEGER) AS sign FROM part")
query("bsi_extremes", lambda s, d: I.extremes(prices(s, d)), "SELECT min(val) AS low, max(val) AS high, count(*) AS ids, CAST(length(bin(max(val))) AS BIGINT) AS bits FROM I", IDX)
query("bsi_pairs", lambda s, d: I.check_domain(sizes(s, d), 50), "SELECT p_partkey AS col_id, CAST(p_size AS BIGINT) AS val FROM part")

# Statistics
STATS = "c AS (SELECT set_id, v >> 16 AS chunk, count(*) AS card, CAST(sum(fresh) AS BIGINT) AS runs FROM (SELECT set_id, v, CASE WHEN lag(v) OVER (PARTITION BY set_id, v >> 16 ORDER BY v) + 1 = v THEN 0 ELSE 1 END AS fresh FROM B) GROUP BY ALL), k AS (SELECT *, least(CASE WHEN card <= 4096 THEN 2 * card ELSE 8192 END, 2 + 4 * runs) AS bytes, CASE WHEN 2 + 4 * runs < CASE WHEN card <= 4096 THEN 2 * card ELSE 8192 END THEN 'run' WHEN card <= 4096 THEN 'array' ELSE 'bitmap' END AS kind FROM c)"
query("chunk_stats", lambda s, d: S.chunks(flags(s, d)), "SELECT set_id, chunk, card, runs, kind, bytes FROM k", f"{FLAG}, {STATS}")
SUMMARY = "SELECT set_id, count(*) FILTER (WHERE kind = 'array') AS arrays, count(*) FILTER (WHERE kind = 'bitmap') AS bitmaps, count(*) FILTER (WHERE kind = 'run') AS runs, CAST(coalesce(sum(card) FILTER (WHERE kind = 'array'), 0) AS BIGINT) AS array_card, count(*) FILTER (WHERE kind = 'array') / count(*) AS array_share, count(*) FILTER (WHERE kind = 'bitmap') / count(*) AS bitmap_share, count(*) FILTER (WHERE kind = 'run') / count(*) AS run_share, avg(card) FILTER (WHERE kind = 'array') AS mean_array_card FROM k GROUP BY set_id"
query("collection_summary", lambda s, d: S.collection_summary(flags(s, d)), "SELECT count(DISTINCT set_id) AS sets, count(*) FILTER (WHERE kind = 'array') AS arrays, count(*) FILTER (WHERE kind = 'bitmap') AS bitmaps, count(*) FILTER (WHERE kind = 'run') AS runs, CAST(coalesce(sum(card) FILTER (WHERE kind = 'array'), 0) AS BIGINT) AS array_card FROM k", f"{FLAG}, {STATS}")
query("chunk_summary", lambda s, d: S.summary(flags(s, d)), SUMMARY, f"{FLAG}, {STATS}")
query("layout_advice", lambda s, d: S.recommend(S.summary(flags(s, d))).select("set_id", "advice"), f"SELECT set_id, CASE WHEN array_share > 0.75 AND mean_array_card < 2048 THEN 'rows' WHEN array_share > 0.75 THEN 'words' WHEN runs / (arrays + bitmaps + runs) > 0.8 THEN 'ranges' ELSE 'packed' END AS advice FROM ({SUMMARY})", f"{FLAG}, {STATS}")
query("portable_size", lambda s, d: S.portable_size(flags(s, d)), "SELECT set_id, CAST(CASE WHEN max(CAST(kind = 'run' AS INTEGER)) = 1 THEN 4 + ceil(count(*) / 8) + 4 * count(*) + CASE WHEN count(*) >= 4 THEN 4 * count(*) ELSE 0 END ELSE 8 + 8 * count(*) END + sum(bytes) AS BIGINT) AS bytes FROM k GROUP BY set_id", f"{FLAG}, {STATS}")

# Formats
query("portable_round_trip", lambda s, d: SRC.decode(SRC.encode(prio(s, d))), "SELECT set_id, v FROM B", PRIO)
query("portable_valid", lambda s, d: SRC.valid(SRC.encode(flags(s, d)).unionByName(SRC.encode(flags(s, d)).select(F.concat("set_id", F.lit(" cut")).alias("set_id"), F.expr("substring(data, 1, length(data) - 1)").alias("data")))).select("set_id", "valid"), "SELECT set_id, true AS valid FROM (SELECT DISTINCT set_id FROM B) UNION ALL SELECT set_id || ' cut', false FROM (SELECT DISTINCT set_id FROM B)", FLAG)
query("size_bound", lambda s, d: flags(s, d).groupBy("set_id").agg(F.count("*").alias("card"), (F.max("v") + 1).alias("universe")).select("set_id", S.size_bound(F.col("card"), F.col("universe")).alias("bytes")), "SELECT set_id, CAST(greatest(8, 4 + ceil(k / 8)) + 8 * k + least(2 * card, 8192 * k) AS BIGINT) AS bytes FROM (SELECT set_id, card, least(ceil(u / 65536), card) AS k FROM (SELECT set_id, count(*) AS card, max(v) + 1 AS u FROM B GROUP BY set_id))", FLAG)
query("memory_size", lambda s, d: S.memory_size(flags(s, d)), "SELECT set_id, CAST(8 + sum(2 + CASE kind WHEN 'array' THEN 4 + 2 * card WHEN 'bitmap' THEN 8192 ELSE 4 + 4 * runs END) AS BIGINT) AS bytes FROM k GROUP BY set_id", f"{FLAG}, {STATS}")
query("sliced_format", lambda s, d: SRC.decode_sliced(SRC.encode_sliced(sizes(s, d), 6)), "SELECT p_partkey AS col_id, CAST(p_size AS BIGINT) AS val FROM part")
query("sliced_stream_format", lambda s, d: SRC.decode_sliced(SRC.encode_sliced(sizes(s, d), 6, stream=True), stream=True), "SELECT p_partkey AS col_id, CAST(p_size AS BIGINT) AS val FROM part")
query("range_format", lambda s, d: SRC.decode_range(SRC.encode_range(prices(s, d, "rid"), (1 << 40) - 1)), "SELECT id AS rid, val FROM I", IDX)
query("portable_bytes", lambda s, d: SRC.encode(flags(s, d)).select("set_id", F.octet_length("data").cast("long").alias("bytes")), _SQL["portable_size"])
query("bitset_words", lambda s, d: SRC.from_bitset(SRC.to_bitset(prio(s, d))), "SELECT set_id, v FROM B", PRIO)
query("bits_get", lambda s, d: BITS.get(first(s, d), 100, 800), "SELECT v - 100 AS v FROM a WHERE v >= 100 AND v < 800", PAIR)
query("bits_measures", lambda s, d: BITS.measures(first(s, d)), "SELECT coalesce(max(v) + 1, 0) AS length, CAST(ceil(coalesce(max(v) + 1, 0) / 64) * 64 AS BIGINT) AS size, count(*) AS card, count(*) = 0 AS empty FROM a", PAIR)
query("bits_bytes", lambda s, d: BITS.to_bytes(first(s, d)), "SELECT v >> 3 AS byte, CAST(sum(1 << (v & 7)) AS INTEGER) AS value FROM a GROUP BY 1", PAIR)
for _kind in ("arrays", "runs"):
    query(f"build_for_{_kind}", lambda s, d, k=_kind: L.unbuild(L.build(flags(s, d), getattr(L.BuildOptions, f"optimise_for_{k}")())), "SELECT set_id, v FROM B", FLAG)
query("build_by_density", lambda s, d: L.unbuild(L.build(flags(s, d), L.BuildOptions.expected_density(0.1))), "SELECT set_id, v FROM B", FLAG)
query("text_sets", lambda s, d: SRC.parse_text(prio(s, d).groupBy("set_id").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("line")), "line").select("set_id", "v"), "SELECT set_id, v FROM B", PRIO)
query("text_ranges", lambda s, d: SRC.parse_ranges(O.runs(prio(s, d)).groupBy("set_id").agg(F.array_join(F.collect_list(F.concat_ws(":", "start", F.col("end") + 1)), ",").alias("line")), "line").select("set_id", "v"), "SELECT set_id, v FROM B", PRIO)
