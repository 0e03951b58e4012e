"""The operators and the pipeline's stages against plain loops and against their SQL on fixtures where their rules act."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from setwise.llm import bpe, common, licenses, line_spread, mixing, near_copies, quality, registry, simhash, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def squash(line):
    return re.sub(SPACE, " ", line).strip(" ").lower()


def md5(text):
    return hashlib.md5((text or "").encode()).digest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def templates(spark):
    """Documents of two hosts: frequent lines, copies, near copies, repeated rows, nulls."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(rng.choice([f"w{k}" for k in range(4000)], n))
    head, copied = f"Menu {word(60)}", word(120)
    rows = []
    for i in range(60):
        own = word(25 if i < 40 else 200)
        rows.append((i, f"{head.upper() if i % 2 else head}  \n{own}", "en", "a", 0))
    rows += [(100 + i, f"{copied}\nsame", "en", "a", 0) for i in range(30)] + [(200, f"{copied}\nother {word(3)}", "en", "a", 0), (200, None, "en", "a", 0), (0, rows[0][1], "en", "a", 0)]
    for i in range(30):
        text = copied.split()
        text[i % 20 :: 40] = [f"n{i}"] * len(text[i % 20 :: 40])
        rows.append((300 + i, " ".join(text), "fr", None if i % 2 else "b", 0))
    rows += [(400 + i, f"shared by sites {head[:200]}\n{word(90)}", "de", f"site{i}", 0) for i in range(9)]
    rows += [(None, word(70), None, None, None), (None, word(70), None, None, None), (500, "", None, "b", 0), (501, " \n ", None, "b", 0), (502, "word " * 3000, None, "b", 0)]
    return spark.createDataFrame(rows, DOCS)


def judged(rows):
    """quality's verdicts by plain loops: kept for each row."""
    by_host = defaultdict(set)
    for r in rows:
        by_host[r["source"]].add((r["doc_id"], r["text"] or ""))
    gone = set()
    for host, own in by_host.items():
        most, docs, texts = max(20, 0.02 * len(own)), Counter(), defaultdict(set)
        for _, text in own:
            for line in {squash(x) for x in text.split("\n") if words(x)}:
                docs[line] += 1
                texts[line].add(text)
        bad = {line: min(texts[line], key=md5) for line, n in docs.items() if n > most}
        for text in {t for _, t in own}:
            lines = [x for x in text.split("\n") if words(x)]
            lost = sum(len(words(x)) for x in lines if squash(x) in bad and bad[squash(x)] != text)
            if lost > 0.5 * sum(len(words(x)) for x in lines):
                gone.add((host, text))
    out = []
    for r in rows:
        w = words(r["text"])
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        out.append(not (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (r["source"], r["text"] or "") not in gone)
    return out


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_the_line_rule_rejects(spark, templates):
    rows = templates.collect()
    want, got = judged(rows), quality.judge(templates)
    assert 30 < sum(want) < len(rows) - 30
    assert Counter((r["doc_id"], r["kept"]) for r in got.collect()) == Counter((r["doc_id"], k) for r, k in zip(rows, want))
    assert rows_of(quality.good_documents(templates)) == sorted(repr(tuple(r)) for r, k in zip(rows, want) if k)
    con, documents = duckdb.connect(), templates.toPandas()  # noqa: F841
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    plain = lambda r: repr(tuple(None if x is None or x != x else int(x) for x in r))
    assert sorted(map(plain, got.select(*cols).collect())) == sorted(map(plain, con.execute(f"SELECT {', '.join(cols)} FROM ({quality.ORACLE})").fetchall()))


@pytest.mark.parametrize("n,gone", [(22, False), (23, True)])
def test_a_large_host_has_a_higher_limit(spark, n, gone):
    """2 % of 1,100 documents are 22: a line of 22 documents stays, of 23 goes."""
    line = " ".join(f"t{k}" for k in range(60))
    rows = [(i, (f"{line}\n" if i < n else "") + " ".join(f"u{i}_{k}" for k in range(55)), "en", "big", 0) for i in range(1100)]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert len(kept) == (1100 - n + 1 if gone else 1100)


def test_line_spread_is_its_sql(spark, templates):
    con, documents = duckdb.connect(), templates.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    out = line_spread.clean_documents(templates.select("doc_id", "text", "source"), keep_counts=True).select("doc_id", "n_lines", "n_removed", "text")
    assert out.where("n_removed > 0").count() >= 8
    assert rows_of(out) == sorted(map(repr, con.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({line_spread.ORACLE})").fetchall()))


def test_warc_is_its_sql_with_revisits(spark, tmp_path):
    long = ["<p>ä</p>" * 30_000, "x" * 999, "y" * 1000, None, "", "z" * 200_000]
    rows = [(i, f"http://h/{i}", long[i % 6]) for i in range(40)] + [(39, "again", long[3]), (None, None, long[2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = warc.op2(spark, str(tmp_path))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got.where("record_type = 'revisit'").count() == 18
    assert rows_of(got.select(*cols)) == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({warc.ORACLE})").fetchall()))
    chunks = warc.read_chunks(warc.write_archives(pages, f"file://{tmp_path}/w"))
    ids = chunks.where("last").groupBy("record_id").count().where("count > 1")
    assert chunks.where("chunk > 0").count() > 5 and ids.count() == 0


def test_fingerprints_one_bit_at_a_time(documents):
    rows = documents.limit(30).collect()
    for text in [r["text"] for r in rows] + [None, "", "A b", "one TWO three four five", "é " * 9]:
        w = [x.encode() for x in words(lower(text))]
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_masks_are_all_split(spark):
    masks = [m for m in {int(x) for x in np.random.default_rng(1).integers(1, 1 << 40, 300)}]
    got = spark.createDataFrame([(m,) for m in masks], "mask long").mapInArrow(simhash._finer(4), "mask long, finer long").collect()
    assert {(r["mask"], r["finer"]) for r in got} == {(m, simhash._signed(x)) for m in masks for x in simhash._split_masks(m, 4)}


def test_forest_links_what_all_pairs_link():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 60, np.uint64)
        sets = []
        for _ in range(25):
            x = base.copy()
            x[rng.integers(0, 60, int(rng.integers(0, 12)))] = rng.integers(0, 1 << 60, 1, np.uint64)
            sets.append(np.unique(x))
        sim = np.array([near_copies.simhash_of(x) for x in sets], np.uint64)
        root = rng.integers(0, 20, 25)
        i, j = np.triu_indices(25, 1)
        near = np.array([near_copies.similar(sets[a], sets[b]) and bin(int(sim[a] ^ sim[b])).count("1") <= near_copies.FAR for a, b in zip(i, j)])
        same = root[i] == root[j]
        want = simhash._roots(25, i[near | same], j[near | same])
        got = near_copies.forest(root, sim, sets)
        ties = [(a, b) for a, b in zip(i[same], j[same])] + got
        assert (simhash._roots(25, *np.array(ties).reshape(-1, 2).T) == want).all() and all(near_copies.similar(sets[a], sets[b]) for a, b in got)
        assert len(got) < 25


def test_near_copies_meet_by_blocks_of_fingerprints():
    rng, at = np.random.default_rng(8), near_copies.blocks(1000)
    for a, b, both in ((4, 5, 4), (9, 9, 8), (40, 50, 40), (450, 450, 400)):  # pairs at the similarity itself
        for _ in range(50):
            found = rng.integers(0, 1 << 63, a + b - both, np.uint64)
            wide = np.stack([near_copies.wide_simhash(x) for x in (found[:a], found[a - both :])])
            assert near_copies.similar(np.sort(found[:a]), np.sort(found[a - both :])) and wide[0, 0] == near_copies.simhash_of(found[:a])
            bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
            meet = (bits[0][at] == bits[1][at]).all(1)
            one, two = near_copies.keys_of(wide, at)
            assert meet.any() and ((one == two) == meet).all()


def test_groups_connect_what_all_pairs_of_a_bucket_connect():
    rng = np.random.default_rng(9)
    for _ in range(30):
        base = rng.integers(0, 1 << 63, (3, 2), np.uint64)
        x = base[rng.integers(0, 3, 60)] ^ (rng.integers(0, 1 << 63, (60, 2), np.uint64) & rng.integers(0, 1 << 63, (60, 2), np.uint64) & rng.integers(0, 1 << 63, (60, 2), np.uint64))
        key = np.sort(rng.integers(0, 3, 60) << 32 | rng.integers(10, 16, 60))
        i, j = np.triu_indices(60, 1)
        n = key & 0xFFFFFFFF
        near = (key[i] >> 32 == key[j] >> 32) & (5 * n[i] >= 4 * n[j]) & (np.bitwise_count(x[i] ^ x[j]).sum(1) <= near_copies.WIDE_FAR)
        got = near_copies.grouped(key, *np.ascontiguousarray(x.T))
        assert (got == simhash._roots(60, i[near], j[near])).all() and 1 < len(set(got.tolist())) < 60


def test_blocks_lose_no_link(spark, templates):
    rng = np.random.default_rng(5)
    rows, w = [], rng.choice([f"w{k}" for k in range(900)], 150).tolist()
    for i in range(60):  # a long chain in one bucket or another
        rows.append((i, " ".join(w), "en", "a", 0))
        w[int(rng.integers(0, 150))] = f"x{i}"
        w[int(rng.integers(0, 150))] = f"y{i}"
    docs = spark.createDataFrame(rows, DOCS)
    ids = lambda df: sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()))
    whole = ids(near_copies.near_copies(docs))
    assert whole == ids(near_copies.near_copies(docs, most=3, part=400))
    assert len({r[2] for r in whole}) < 60
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def found_by_hand(text):
    """labels and score of the license rules by plain loops."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    form, plain = "".join(f" {x} " for x in w), f" {' '.join(w)} "
    if not w or not any(g in (text or "").lower() for g in licenses.gate_words()):
        return set(), 0.0
    spans = []
    for label, keyword, pattern, priority, weight in licenses.rules():
        if keyword in plain:
            spans += [(m.start(), -m.end(), -priority, label, -weight) for m in re.finditer(licenses._spaced(pattern), form)]
    outer, reach = [], -1
    for s in sorted(spans):
        if -s[1] > reach:
            outer.append(s)
            reach = -s[1]
    left = [s for k, s in enumerate(outer) if not any(o[2] < s[2] and o[0] < -s[1] and -o[1] > s[0] for j, o in enumerate(outer) if j != k)]
    return {s[3] for s in left}, max([-s[4] for s in left], default=0.0)


def test_licenses_by_hand(spark, documents):
    texts = [r["text"] for r in documents.collect()] + [
        None, "", "MIT", "released under the terms of the GNU General Public License version 3 or later", "Licensed under the MIT License or the Apache License, Version 2.0; CC BY-SA 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy. All rights reserved. Copyright (c) 2019 2020", "cc by nc sa 3.0 unported, creative commons attribution share alike 2.0 license",
        "SPDX-License-Identifier: GPL-2.0-only", "THE SOFTWARE IS PROVIDED AS IS, without warranty of any kind. Redistribution and use in source and binary forms", "distributed under the BSD 3 clause license licensed under the x11 licence",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. Llama 3.1 Community License Agreement; Open Government Licence v3.0; all rights remain reserved",
        "Redistributions of source code must retain the above copyright notice. You should have received a copy of the GNU Lesser General Public License. Netscape Public License 1.1, Zope Public License 2.1",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = set()
    for r in licenses.scan(df).collect():
        labels, score = found_by_hand(texts[r["doc_id"]])
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(texts[r["doc_id"]]))
        base, places = set(), []
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        assert r["labels"] == ",".join(sorted(labels | base)) and r["base_labels"] == ",".join(sorted(base))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert math.isclose(r["score"], max(score, 0.5 if places else 0.0))
        seen |= labels
    assert len(seen) > 10 and len({r[0] for r in licenses.rules()}) > 40


def test_newer_characters_are_the_librarys():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path())
    new = [x for x in range(0x300, 0x33500) if not 0xD800 <= x < 0xE000]
    for x in new[::7]:
        text = f"a{chr(x)}b"
        assert c.encode(text) == t.encode(text, add_special_tokens=False).ids, hex(x)


def test_sums_beyond_the_table_are_met_in_units():
    big = [9_000_001, 7_000_003, 5_000_009, 3_000_017]
    take = mixing.bounded_knapsack(big, [3, 3, 3, 3], 24_000_000)
    got = sum(a * b for a, b in zip(big, take))
    sums = {0}
    for n in big:
        sums = {s + k * n for s in sums for k in range(4)}
    assert abs(abs(got - 24_000_000) - min(abs(s - 24_000_000) for s in sums)) <= 4 * 12


@pytest.mark.parametrize("name", ["op1_mix_to_weights", "op7_bpe", "op8_webp", "op9_simhash", "op10_license_rules"])
def test_registered_queries_run_over_all_rows(spark, documents, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents.select("doc_id").collect())
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    if name == "op8_webp":
        for r in rows:
            raw = text[r["doc_id"]].encode()
            raw += b"\xff" * (-len(raw) % 576 or 576 * (not raw))
            assert (r["payload_sha256"], r["n_bytes"], r["payload_bytes"]) == (hashlib.sha256(raw).hexdigest(), len(text[r["doc_id"]].encode()), len(raw))
    if name == "op7_bpe":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(bpe.default_path())
        for r in rows:
            ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
            back = t.decode(ids, skip_special_tokens=False)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    if name == "op1_mix_to_weights":
        assert all(r["size"] == len(words(text[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"] for r in rows)


def spread(rows):
    """line_spread's texts by plain loops."""
    sites, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if words(line):
                sites[squash(line)].add(r["source"])
                texts[squash(line)].add(r["text"])
    bad = {x: min(texts[x], key=md5) for x, s in sites.items() if len(s) >= line_spread.SITES}
    keep = lambda r, x: not (squash(x) in bad and words(x) and bad[squash(x)] != r["text"])
    return [None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if keep(r, x)) for r in rows]


def survivors(rows):
    """near_dedup's doc_ids by all pairs."""
    sets = []
    for r in rows:
        w = words(lower(r["text"]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = simhash._roots(len(sets), *np.array(links, int).reshape(-1, 2).T)
    low = {k: min((r["doc_id"] for r, x in zip(rows, root) if x == k and r["doc_id"] is not None), default=None) for k in set(root.tolist())}
    return sorted(map(repr, low.values()))


def test_pipeline_by_plain_loops(spark, templates, documents, tmp_path):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode"]
    templates.unionByName(documents.limit(60).withColumn("doc_id", F.col("doc_id") + 10_000)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    want = sorted(repr(tuple(r)) for r, k in zip(rows, judged(rows)) if k)
    docs = common.materialise(corpus_pipeline.quality_rules(spark, docs, SF), "a")
    assert rows_of(docs) == want and docs.count() < len(rows)
    rows = docs.collect()
    want = Counter((r["doc_id"], t) for r, t in zip(rows, spread(rows)))
    docs = common.materialise(corpus_pipeline.line_dedup(spark, docs, SF), "b")
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == want
    rows = docs.collect()
    docs = common.materialise(corpus_pipeline.near_dedup(spark, docs, SF), "c")
    assert sorted(repr(r["doc_id"]) for r in docs.collect()) == survivors(rows) and docs.count() < len(rows)
    kept = {(r["doc_id"], r["text"], r["source"]) for r in docs.collect()}
    mixed = common.materialise(corpus_pipeline.mix_sources(spark, docs, SF), "d").collect()
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed)
    assert set(times) <= kept and max(times.values()) <= 2
    took = Counter()
    for r in mixed:
        took[r["source"]] += len(words(r["text"]))
    for r in mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("longest")).collect():
        assert took[r["source"]] == r["taken"] and abs(r["taken"] - r["target"]) <= r["longest"]
    t = Tokenizer.from_file(bpe.default_path())
    ids = Counter((r["doc_id"], hashlib.sha256(np.array(t.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in mixed)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids


def test_stages_take_empty_tables_and_clashing_names(spark, templates, tmp_path):
    names = ("id", "n", "k", "lines", "copy", "times", "label", "key", "host", "fp", "b", "root", "size", "gone", "h", "doc_id_", "component_id", "fingerprint", "taken", "form", "rule")
    odd = templates.limit(12).withColumns({n: F.lit(1) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() > 0 or name == "quality_rules"
        assert name == "encode" or out.columns == odd.columns
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_windows_score_alike_together_and_alone_where_gates_saturate():
    from setwise.llm import toxicity

    rng, net = np.random.default_rng(2), toxicity.Network()
    for scale in (1, 300):
        gates = {d: (rng.standard_normal((50, 3 * toxicity.HIDDEN)) * scale).astype(np.float32) for d in "fb"}
        line = rng.integers(0, 50, 200)
        at = np.lib.stride_tricks.sliding_window_view(line, toxicity.WINDOW)
        assert np.allclose(net.every(gates, line), net.forward(gates, at)[0], atol=1e-4)
