"""Edge values and laws that the tables do not reach."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from setwise.functions.integers import order_key_of_double, unsigned64_key
from setwise.operators import algebra as A
from setwise.operators import bitset as BITS
from setwise.operators import indexes as I
from setwise.operators import layout as L
from setwise.operators import longs as U64
from setwise.operators import order as O
from setwise.operators import statistics as S
from setwise.sources import portable
from setwise.sources import sets as SRC
from setwise.streaming import builder


def make(spark, values, name="s"):
    return spark.createDataFrame([(name, int(v)) for v in values], "set_id string, v long")


def values(df, column="v"):
    return sorted(r[column] for r in df.collect())


EDGES = [0, 1, 2, 63, 64, 32768, 65535, 65536, 65537, 2**31 - 1, 2**31, 2**32 - 1]


def test_worked_example(spark):
    a, b = make(spark, [1, 2, 3, 1000]), make(spark, range(4000, 4255))
    assert values(O.select(a, 3)) == [1000]
    assert O.rank_of(a, 2).first()["rank"] == 2
    assert not A.intersects_range(a, 7, 8).first()[0]
    assert A.union(a, b).count() == 259


def test_layouts_keep_edges(spark):
    a = make(spark, EDGES)
    assert values(L.from_words(L.to_words(a))) == EDGES
    assert L.packed_cardinality(L.to_packed(a)).first()["card"] == len(EDGES)


def test_wide_and_counts_empty_sets(spark):
    sets = make(spark, [1, 2], "a").union(make(spark, [2, 3], "b"))
    assert values(A.wide_and(sets, 2)) == [2]
    assert values(A.wide_and(sets, 3)) == []
    assert values(A.wide_and(sets.limit(0), 0)) == []
    words = L.word_algebra(L.to_words(sets), "and", 3)
    assert words.count() == 0


def test_empty_ranges_and_sets(spark):
    a, none = make(spark, [5]), make(spark, [])
    assert A.contains_range(a, 6, 6).first()[0] is False
    assert A.contains_set(a, none).first()[0] is True
    assert A.intersects(a, none).first()[0] is False
    assert values(A.value_range(spark, 9, 3)) == []
    with pytest.raises(ValueError):
        A.value_range(spark, -1, 3)


def test_shift_drops_what_leaves(spark):
    a = make(spark, EDGES)
    assert values(A.shift(a, 65536)) == [v + 65536 for v in EDGES if v + 65536 < 2**32]
    assert values(A.shift(a, -65536)) == [v - 65536 for v in EDGES if v >= 65536]


def test_rank_select_and_runs_across_chunks(spark):
    a = make(spark, EDGES)
    assert [r["rank"] for r in O.ranked(a).orderBy("v").collect()] == list(range(1, len(EDGES) + 1))
    assert [(r["start"], r["end"]) for r in O.runs(a).orderBy("start").collect()] == [(0, 2), (63, 64), (32768, 32768), (65535, 65537), (2**31 - 1, 2**31), (2**32 - 1, 2**32 - 1)]
    n = O.absent_neighbours(a, 65536).first()
    assert (n["next_absent"], n["previous_absent"]) == (65538, 65534)
    assert O.absent_neighbours(a, 2**32 - 1).first()["next_absent"] == -1
    assert O.absent_neighbours(a, 1).first()["previous_absent"] == -1


def test_or_not_keeps_what_lies_above(spark):
    a, b = make(spark, [1, 500]), make(spark, [1, 3])
    assert values(A.or_not(a, b, 5)) == [0, 1, 2, 4, 500]


def test_index_domain_merge_and_ties(spark):
    i = spark.createDataFrame([(0, 0), (1, 6), (2, 1), (3, 7), (4, 0), (5, 9), (6, 9), (7, 8), (8, 9), (9, 8)], "col_id long, val long")
    assert values(I.top_k(i, 4), "col_id") == [5, 6, 8, 9] == values(I.sliced_top_k(i, 4, 4), "col_id")
    assert values(I.top_k(i, 0), "col_id") == []
    with pytest.raises(PySparkException):
        I.merge(i, i).collect()
    with pytest.raises(PySparkException):
        I.check_domain(i, 3).collect()
    assert I.total(i, spark.range(5, 20).select(F.col("id").alias("col_id"))).first().asDict() == {"total": 43, "n": 15}


def test_unsigned_extremes(spark):
    i = spark.createDataFrame([(0, 0), (1, -(2**63)), (2, -1)], "rid long, val long")
    assert values(I.compare_unsigned(i, "gt", -1), "rid") == []
    assert values(I.compare_unsigned(i, "lte", -2), "rid") == [0, 1]
    assert values(I.compare_unsigned(i, "gte", -(2**63)), "rid") == [1, 2]


def test_double_order(spark):
    x = [-1e300, -2.5, -1.0, -1e-300, 0.0, 1e-300, 0.1, 1.0, 1.5, 2.0, 3.0, 1e16, 1e300]
    got = spark.createDataFrame([(v,) for v in x], "x double").orderBy(unsigned64_key(order_key_of_double(F.col("x"))))
    assert [r[0] for r in got.collect()] == x


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60), st.integers(0, 2**32 - 70000), st.integers(0, 70000))
def test_portable_round_trip(some, start, length):
    want = np.unique(np.array([*some, *range(start, start + length)], np.int64))
    data = portable.encode(want)
    got, size = portable.decode(data)
    assert size == len(data) and (got == want).all() and portable.valid(data)
    assert len(data) <= S.size_bound(len(want), 2**32) + 64


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40))
def test_64_bit_round_trips(some):
    want = sorted({v % 2**64 for v in some})
    for encode, decode in ((portable.encode64, portable.decode64), (portable.encode64_legacy, portable.decode64_legacy)):
        assert [int(v) % 2**64 for v in decode(encode(some))] == want


def test_bad_bytes():
    good = portable.encode([1, 2, 3, 70000])
    for data in (b"", b"\x3b\x30", b"\x3a\x30\x00\x00\xff\xff\xff\xff", good[:-1], b"\x00" * 12, b"\x3b\x30\xff\xff"):
        with pytest.raises(portable.FormatError):
            portable.decode(data)
    assert not portable.valid(good + b"x") and not portable.valid(None)


def test_index_format():
    assert portable.decode_index(portable.encode_index([1, 5, 9], [0, 6, 7])) == {1: 0, 5: 6, 9: 7}


def test_size_formula_is_the_writers(spark):
    rng = np.random.default_rng(1)
    sets = make(spark, np.unique(rng.integers(0, 300_000, 9000)), "a").union(make(spark, range(100, 90_000), "b")).union(make(spark, np.unique(rng.integers(0, 65536, 30000)), "c"))
    said = {r["set_id"]: r["bytes"] for r in S.portable_size(sets).collect()}
    assert said == {r["set_id"]: len(r["data"]) for r in SRC.encode(sets).collect()}


def test_zip_and_bitset_limits(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.txt", "1,5,9\n")
        z.writestr("two.txt", "2")
    got = SRC.parse_text(SRC.read_zipped_text(spark, str(tmp_path / "a.zip")), "line")
    assert sorted(map(tuple, got.collect())) == [("one.txt", 1), ("one.txt", 5), ("one.txt", 9), ("two.txt", 2)]
    with pytest.raises(PySparkException):
        SRC.to_bitset(make(spark, [2**31])).collect()


def test_streamed_words(spark, tmp_path):
    make(spark, [1, 64, 64, 65536]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("set_id string, v long").parquet(str(tmp_path / "in"))
    q = builder.growing_words(stream).writeStream.outputMode("complete").format("memory").queryName("words").start()
    q.processAllAvailable()
    q.stop()
    assert values(L.from_words(spark.table("words"))) == [1, 64, 65536]


LONGS = [0, 1, 65535, 65536, 2**32 - 1, 2**32, 2**48, 2**63 - 1, 2**63, 2**63 + 70000, 2**64 - 1]


def longs(spark, values):
    return spark.createDataFrame([(U64.held(v),) for v in values], "v long")


def unsigned(df, column="v"):
    return sorted(r[column] % 2**64 for r in df.collect())


def test_64_bit_edges(spark):
    a = longs(spark, LONGS)
    assert [r["v"] % 2**64 for r in U64.ranked(a).orderBy("rank").collect()] == LONGS
    assert [U64.select(a, j).first()["v"] % 2**64 for j in (0, 7, 8, 10)] == [LONGS[j] for j in (0, 7, 8, 10)] and U64.select(a, 11).count() == 0
    assert unsigned(U64.limit(a, 4)) == LONGS[:4] and [r["v"] % 2**64 for r in U64.last(a, 3).collect()] == LONGS[:-4:-1]
    assert tuple(x % 2**64 for x in U64.ends(a).first()) == (0, 2**64 - 1) and U64.rank_of(a, 2**63).first()[0] == 9
    assert unsigned(U64.select_range(a, 2**63 - 1, 2**63 + 1)) == [2**63 - 1, 2**63] and unsigned(U64.select_range(a, 2**63, 2**64)) == LONGS[8:]
    assert unsigned(U64.add_range(a, 2**64 - 3, 2**64)) == sorted({*LONGS, 2**64 - 3, 2**64 - 2})
    assert unsigned(U64.flip_range(a, 2**63 - 2, 2**63 + 1)) == sorted(({*LONGS} - {2**63 - 1, 2**63}) | {2**63 - 2})
    assert unsigned(U64.flip(U64.flip(a, -1), 5)) == sorted(({*LONGS} - {2**64 - 1}) | {5}) and unsigned(U64.add(a, 2**64 - 1)) == LONGS
    assert unsigned(U64.value_range(spark, 2**63 - 2, 2**63 + 2)) == list(range(2**63 - 2, 2**63 + 2))
    for start, end in ((5, 5), (6, 5), (0, 2**64 + 1)):
        with pytest.raises(ValueError):
            U64.add_range(a, start, end)
    assert U64.int_cardinality(a).first()[0] == len(LONGS)


def stretches(df):
    return sorted((r["first"] % 2**64, r["last"] % 2**64, r["present"]) for r in df.collect())


def test_presence_as_runs(spark):
    got = stretches(U64.presence_runs(longs(spark, LONGS), 0, 2**64))
    assert got[0] == (0, 1, True) and got[-1] == (2**64 - 1, 2**64 - 1, True)
    assert all(b[0] == a[1] + 1 for a, b in zip(got, got[1:])) and sum(b - a + 1 for a, b, p in got if p) == len(LONGS)
    assert all(not p or a >> 16 == b >> 16 for a, b, p in got)
    assert stretches(U64.presence_runs(longs(spark, []), 7, 2**63 + 9)) == [(7, 2**63 + 8, False)]
    a = make(spark, EDGES).select("v")
    got = stretches(O.presence_runs(a, 1, 70000))
    assert got == [(0, 1, True), (2, 61, False), (62, 63, True), (64, 32766, False), (32767, 32767, True), (32768, 65533, False), (65534, 65534, True), (65535, 65536, True), (65537, 69999, False)]
    assert stretches(O.presence_runs(a.limit(0), 5, 10)) == [(0, 9, False)] and O.presence_runs(a, 5, 0).count() == 0
    assert values(O.present_positions(a, 1, 70000), "position") == [v - 1 for v in EDGES if 1 <= v < 70001]


def test_pages_limits_and_seeks(spark):
    a = make(spark, EDGES)
    assert [values(O.page(a, 5, k)) for k in range(4)] == [EDGES[:5], EDGES[5:10], EDGES[10:], []]
    assert values(O.limit(a, 7)) == EDGES[:7] and values(O.limit(a, 100)) == EDGES and values(O.limit(a, 0)) == []
    assert values(O.seek(a, 65536)) == [v for v in EDGES if v >= 65536] and O.peek(a, 70000).first()["next"] == 2**31 - 1 and O.peek(a, 2**32).count() == 0


def test_equal_sets_and_emptiness(spark):
    sets = make(spark, [1, 2], "a").union(make(spark, [2, 3], "b")).union(make(spark, [2, 1], "c"))
    assert dict(map(tuple, A.equal_sets(sets).collect())) == {"a": "a", "b": "b", "c": "a"}
    assert A.is_empty(A.clear(sets)).first()[0] and not A.is_empty(sets).first()[0]
    assert A.exceeds(sets, 5).first()[0] and not A.exceeds(sets, 6).first()[0] and not A.exceeds(sets, 2**40).first()[0]
    assert values(A.wide_and(sets)) == [2] and A.wide_and(sets.limit(0)).count() == 0


@pytest.mark.parametrize("top,bits", [(0, 1), (1, 1), (2**48 - 1, 48), (2**48, 49), (2**50 - 1, 50), (2**62, 63)])
def test_slices_in_use(spark, top, bits):
    i = spark.createDataFrame([(0, 0), (1, top), (2, top // 2)], "col_id long, val long")
    assert I.extremes(i).first()["bits"] == bits
    want = [r["col_id"] for r in sorted(i.collect(), key=lambda r: (-r["val"], -r["col_id"]))]
    for k in range(5):
        assert values(I.sliced_top_k(i, k, bits), "col_id") == sorted(want[:k]) == values(I.top_k(i, k), "col_id")


def test_found_sets(spark):
    i = spark.createDataFrame([(0, 0), (1, 6), (2, 1), (3, 7), (5, 9), (9, None)], "col_id long, val long")
    found = spark.createDataFrame([(1,), (3,), (7,), (9,)], "col_id long")
    assert values(I.top_k(i, 1, found), "col_id") == [3] and sorted(map(tuple, I.pairs(i, found).collect())) == [(1, 6), (3, 7)]
    assert values(I.is_in(i, spark.createDataFrame([(6,), (9,)], "val long"), found), "col_id") == [1]
    for top_k in (I.top_k, lambda i, k: I.sliced_top_k(i, k, 4)):
        with pytest.raises(ValueError):
            top_k(i, -1)
    assert I.dense(i, "col_id").first()[0] is False and I.dense(i.where("col_id < 4"), "col_id").first()[0] is True and I.dense(i.limit(0), "col_id").first()[0] is True


def test_written_index(spark, tmp_path):
    i = spark.range(5000).selectExpr("id AS rid", "id * 7919 % 1000 AS val")
    I.write(i, str(tmp_path / "i"), rows=1000)
    assert values(I.compare(I.read(spark, str(tmp_path / "i")), "lt", 3), "rid") == [k for k in range(5000) if k * 7919 % 1000 < 3]


def test_validity_looks_at_offsets_and_forms():
    import struct

    good = portable.encode([1, 5, 70000])
    assert portable.valid(good) and not portable.valid(good[:16] + b"\x00\x01\x00\x00" + good[20:])
    runs = struct.pack("<HH", portable.RUNS, 0) + b"\x01" + struct.pack("<HH", 0, 1) + struct.pack("<HHHHH", 2, 1, 0, 5, 0)  # two runs of one: 10 bytes against 4
    assert portable.decode(runs)[0].tolist() == [1, 5] and not portable.valid(runs)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(-(2**63), 2**63 - 1))
def test_range_format_and_vints(some, x):
    values_ = np.array(some, np.uint64)
    bits = max(1, max(some, default=0).bit_length())
    data = portable.join_range(bits, len(some), *([[y] for y in portable.range_chunk(np.arange(len(some)), values_, bits)] if some else ([], [])))
    assert portable.decode_range(data).tolist() == some
    assert portable.read_vint(portable.vint(x) + b"?", 0) == (x, len(portable.vint(x)))


def test_index_formats_in_tables(spark):
    many = spark.range(70_000).selectExpr("id AS rid", "id * 7919 % 1000 AS val")
    assert SRC.decode_range(SRC.encode_range(many, 1000)).join(many, ["rid", "val"]).count() == 70_000
    wide = spark.createDataFrame([(0, 0), (1, -(2**63)), (2, -1)], "rid long, val long")
    assert sorted(map(tuple, SRC.decode_range(SRC.encode_range(wide, 2**64 - 1)).collect())) == [(0, 0), (1, -(2**63)), (2, -1)]
    for bad in (many.where("rid <> 9"), many.selectExpr("rid", "val + 5000 AS val")):
        with pytest.raises(PySparkException):
            SRC.encode_range(bad, 1000).collect()
    index = spark.createDataFrame([(5, 0), (9, 6), (100_000, 7)], "col_id long, val long")
    for stream in (False, True):
        assert sorted(map(tuple, SRC.decode_sliced(SRC.encode_sliced(index, 3, stream), stream).collect())) == [(5, 0), (9, 6), (100_000, 7)]
        assert SRC.decode_sliced(SRC.encode_sliced(index.limit(0), 3, stream), stream).count() == 0


@pytest.mark.parametrize("form", ["portable64", "legacy64"])
def test_64_bit_formats_in_tables(spark, form):
    sets = longs(spark, LONGS + [7]).withColumn("set_id", F.when(F.col("v") == 7, "b").otherwise("a"))
    blobs = SRC.encode(sets, form)
    assert {r["set_id"]: bytes(r["data"]) for r in blobs.collect()} == {"a": (portable.encode64 if form == "portable64" else portable.encode64_legacy)([U64.held(v) for v in LONGS]), "b": (portable.encode64 if form == "portable64" else portable.encode64_legacy)([7])}
    assert unsigned(SRC.decode(blobs, form).where("set_id = 'a'")) == LONGS


def test_build_options(spark):
    sets = make(spark, EDGES[:-3]).union(make(spark, [3, 4, 5, 5], "t"))
    for options in (L.BuildOptions.optimise_for_arrays(), L.BuildOptions.optimise_for_runs(), L.BuildOptions.constant_memory(), L.BuildOptions.expected_values_per_chunk(9000)):
        assert sorted(map(tuple, L.unbuild(L.build(sets, options)).collect())) == sorted({*map(tuple, sets.collect())})
    with pytest.raises(ValueError):
        L.BuildOptions.expected_values_per_chunk(-1)


def test_bits(spark):
    a = make(spark, [0, 9, 15, 64]).select("v")
    assert values(BITS.get(a, 9, 64)) == [0, 6] and tuple(BITS.measures(a).first()) == (65, 128, 4, False) and tuple(BITS.measures(a.limit(0)).first()) == (0, 0, 0, True)
    assert bytes(BITS.to_byte_array(a).first()[0]) == bytes([1, 0x82, 0, 0, 0, 0, 0, 0, 1])


def test_text_and_zipped_ranges(spark, tmp_path):
    import zipfile

    assert SRC.to_text(make(spark, [3, 1, 20])).first()["text"] == "{1,3,20}" and SRC.to_text(make(spark, [3, 1, 20]), most=4).first()["text"] == "{1,3,...}"
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("one.txt", "1:4,9:10\n")
    assert sorted(map(tuple, SRC.read_zipped_ranges(spark, str(tmp_path / "r.zip")).collect())) == [("one.txt", 1), ("one.txt", 2), ("one.txt", 3), ("one.txt", 9)]


def test_size_bound_as_a_column(spark):
    cases = [(0, 10), (5, 100), (70_000, 2**20), (10, 2**32)]
    df = spark.createDataFrame(cases, "card long, u long").select("card", "u", S.size_bound(F.col("card"), F.col("u")).alias("b"))
    assert {(r["card"], r["u"]): r["b"] for r in df.collect()} == {x: S.size_bound(*x) for x in cases}


def test_text_of_a_large_set_is_whole(spark):
    """Over 0x80000 characters, where the library's own text ends in dots and the query's SQL does not."""
    got = SRC.to_text(spark.range(100_000).selectExpr("'s' AS set_id", "id AS v")).first()["text"]
    assert len(got) > 0x80000 and got == "{" + ",".join(map(str, range(100_000))) + "}"
