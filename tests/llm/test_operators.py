"""Each operator against brute force, an exact round trip or held-out accuracy, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import heapq
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setwise.llm import bpe, common, language, licenses, line_spread, mixing, near_copies, quality, simhash, toxicity, warc, webp

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two three\none two three\nfour", "en", "a", 33), (4, "one two three\none two three\nfour", "en", "a", 33),
    (5, "Licensed under the MIT License. CC BY cc-by, all rights\nreserved All Rights Reserved <|endoftext|> Σίσυφος\x85İ\x1c$#", "en", "b", 110), (6, "word " * 30_000, None, None, 150_000), (None, "null id here", "fr", "b", 12), (7, "é" * 700, "fr", "b", 700),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS).withColumns({"key": F.lit("x"), "size": F.lit(1), "gone": F.lit(2), "host": F.lit(3), "rows": F.lit(4)})


@pytest.fixture(scope="module")
def none(edges):
    return edges.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_meets_targets(spark, documents, edges, none):
    rows = [r.asDict() | {"source": s} for r, s in ((r, r["source"]) for r in mixing.mix(documents).collect())]
    total = sum(r["size"] for r in rows)
    sources = sorted({r["source"] for r in rows})
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    weight, level, full = dict(zip(sources, [3, 1, 2] * len(sources))), None, set()
    while True:  # fill by weight, stop at twice the size, share out what is above
        level = (1.5 * total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and level * weight[s] >= 2 * size[s]}
        if not more:
            break
        full |= more
    for s in sources:
        own = [r for r in rows if r["source"] == s]
        want = 2 * size[s] if s in full else level * weight[s]
        assert abs(own[0]["target"] - want) < 1e-6 and abs(sum(r["taken"] for r in own) - want) <= 30
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(mixing.mix(documents).collect(), key=repr) == sorted(mixing.mix(documents).collect(), key=repr)
    got = {(r["doc_id"], r["size"]) for r in mixing.mix(edges).collect()}
    assert got == {(d, len(words(t))) for d, t, *_ in EDGES}
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns
    out = mixing.mixed_documents(edges)
    assert out.columns == edges.columns
    assert sum(len(words(r["text"])) for r in out.collect()) == sum(r["taken"] for r in mixing.mix(edges).collect())


def test_knapsack_is_exact_where_it_can_be():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths, counts = rng.integers(1, 30, 6).tolist(), rng.integers(0, 4, 6).tolist()
        goal = int(rng.integers(1, 90))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        take = mixing.bounded_knapsack(lengths, counts, goal)
        got = sum(k * n for k, n in zip(take, lengths))
        assert all(k <= c for k, c in zip(take, counts)) and abs(got - goal) == min(abs(s - goal) for s in sums)


def test_warc(spark, tmp_path):
    long = "<p>ü</p>" * 40_000
    rows = [(1, "http://a/\n", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "n", long), (7, "v", long), (7, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "chunk": F.lit(2)})
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", roll=1000)
    chunks = warc.read_chunks(archives, data=True).collect()
    got = sorted(map(tuple, warc.records(warc.read_chunks(archives)).collect()), key=repr)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [(p, size(t), sha(t), "response" if t != long or p == 7 else "revisit", None if t != long or p == 7 else 7) for p, _, t in rows]
    assert got == sorted(want, key=repr)
    assert max(len(r["data"]) for r in chunks) <= warc.CHUNK and sum(r["page_id"] == 7 for r in chunks) > 8
    whole = b"".join(r["data"] for r in sorted((r for r in chunks if r["page_id"] == 7), key=lambda r: (r["path"], r["record"], r["chunk"])))
    assert whole == long.encode() * 2
    assert {r["url"] for r in chunks if r["page_id"] == 2} == {None}
    assert warc.records(warc.read_chunks(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e"))).count() == 0


def test_toxicity_held_out_and_windows(spark, edges):
    bad, good = "idiot moron scum loser", "the of and in thing ing on er ha wh"
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(400):
        w = rng.choice(good.split(), 90).tolist()
        if i % 2:
            w[int(rng.integers(0, 90))] = str(rng.choice(bad.split()))
        texts.append(" ".join(w))
        labels.append(i % 2)
    net = toxicity.Network().train(texts[:300], labels[:300])
    got = toxicity.Scorer(net).scores(texts[300:]) >= 0.7
    assert (got == np.array(labels[300:])).mean() > 0.95
    deep = " ".join(["the"] * 40_000 + ["idiot"] + ["of"] * 7)  # one word in a long text
    assert toxicity.Scorer(net).scores([deep, "the " * 50_000, "", None]).round(1).tolist()[2:] == [0, 0]
    assert toxicity.Scorer(net).scores([deep])[0] > 0.7
    assert toxicity.score(edges, net).count() == len(EDGES)
    assert toxicity.Network().train(["a"], [1]).ready is False
    covered = {p for s in toxicity.starts(1001) for p in range(s, s + toxicity.WINDOW)}
    assert covered == set(range(1001))


def test_toxicity_numbers_words_once_and_anew_when_cleared(monkeypatch):
    net = toxicity.Network(seed=5)
    net.ready = True
    scorer, texts = toxicity.Scorer(net), [f"a{k % 7} b{k} a{k % 3}" for k in range(50)]
    assert scorer._numbers(["x", "y", "x"]).tolist() == [1, 2, 1] and scorer._numbers(["y", "z", "z"]).tolist() == [2, 3, 3]
    x = net.mixed(*toxicity.hashed(["x", "y", "z"]))
    assert all(np.allclose(scorer.gates[d][1:4], net.gates(x, d), atol=1e-6) for d in "fb") and not scorer.number.new
    want = scorer.scores(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 5)
    again = toxicity.Scorer(net)
    assert all(np.allclose(again.scores(texts[i : i + 10]), want[i : i + 10], atol=1e-6) for i in range(0, 50, 10))


def test_toxicity_scores_every_window():
    net = toxicity.Network(seed=5)
    net.ready = True
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(60)], n)) for n in (1, 31, 32, 33, 63, 64, 65, 200, 3000)]
    want = []
    for text in texts:  # each window as a text of its own
        w = text.split()
        alone = [" ".join(w[s : s + 32]) for s in range(max(1, len(w) - 31))]
        want.append(toxicity.Scorer(net).scores(alone).max())
    assert np.abs(toxicity.Scorer(net).scores(texts) - want).max() < 1e-5
    cut, kept = toxicity.Scorer(net), toxicity.TOGETHER
    try:
        toxicity.TOGETHER = 100  # a long text in parts
        assert np.abs(cut.scores(texts) - want).max() < 1e-5
    finally:
        toxicity.TOGETHER = kept


def test_toxicity_learns_nothing_from_the_held_out_labels(spark, documents, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    twice = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 1), (-5, 1, None)], labels.schema))
    for name, toxic in (("a", F.col("toxic")), ("b", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))):
        documents.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        twice.withColumn("toxic", toxic).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    kept, toxicity.Network.train.__defaults__ = toxicity.Network.train.__defaults__, (2,)
    try:
        a, b = (sorted(map(tuple, toxicity.op3(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    finally:
        toxicity.Network.train.__defaults__ = kept
    assert a == b and len(a) == documents.count() and {r[1] for r in a} == {True, False}
    assert all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in a)
    empty = toxicity.score(documents.limit(0), toxicity.Network())
    assert empty.count() == 0 and empty.columns == ["doc_id", "score"]


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocabulary = [(0, [0]), (5, [1, 2]), (9, [3])]
    at, label = np.array([[1, 2, 0], [2, 2, 1]]), np.array([1.0, 0.0])

    def loss():
        x = net.inputs(vocabulary).astype(np.float64)
        z = net.forward({d: net.gates(x, d) for d in "fb"}, at)[0]
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    grad = net.gradients(vocabulary, net.inputs(vocabulary), at, label)
    for name, place in (("rec_f", (2, 3)), ("in_b", (1, 25)), ("att", (4,)), ("out", (7,)), ("word", (5, 1)), ("char", (3, 2)), ("bias_f", (11,))):
        kept = net.p[name][place]
        net.p[name][place] = kept + 1e-4
        up = loss()
        net.p[name][place] = kept - 1e-4
        down = loss()
        net.p[name][place] = kept
        assert abs((up - down) / 2e-4 - grad[name][place]) < 1e-5


def test_quality_edges(spark, edges, none):
    got = {r["doc_id"]: r for r in quality.judge(edges).collect()}
    assert len(quality.judge(edges).collect()) == len(EDGES)
    assert (got[1]["n_words"], got[4]["n_dup_lines"], got[4]["n_repeat_words"], got[5]["n_symbols"]) == (0, 1, 6, 6)
    assert got[6]["n_repeat_words"] == 30_000 and got[6]["base_failed"]
    assert quality.judge(none).count() == 0 and quality.good_documents(edges).columns == edges.columns


def test_frequent_lines_deplete(spark):
    tail = " ".join(f"w{i}" for i in range(40))
    docs = [(i, f"{tail} {tail}x\nown {i} " + " ".join(f"u{i}_{k}" for k in range(30 if i < 25 else 200)), "en", "a", 0) for i in range(40)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert sum(kept[i] for i in range(25)) <= 1 and all(kept[i] for i in range(25, 40))


def test_language(spark, edges, none):
    docs = duckdb.sql(f"SELECT text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    model = language.Model(docs[:140])
    got = model.predict([t for t, _ in docs[140:]])
    assert np.mean([g[0] == x for g, (_, x) in zip(got, docs[140:])]) > 0.85
    assert {x[0] for x in model.predict([None, "", "12 34 !", "² ½ ⅔ ①"])} == {"und"} and language.Model([]).predict(["abc"])[0][0] == "und"
    rows = language.identify(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify(none, model).count() == 0


def test_language_scores_are_sums_over_all_subwords():
    docs = duckdb.sql(f"SELECT text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()[:60]
    model = language.Model(docs)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h ^ ord(c)) * language.MIX[0] & 0xFFFFFFFF
            h ^= h >> 15
        return ((h * (language.MIX[1] + 2 * (len(gram) - 1)) & 0xFFFFFFFF) >> 16) % language.BUCKETS

    texts = ["one Two  zwölf", "", "a", "x" * 3000, docs[0][0][:2000]]
    for kept in (language.KEPT_BYTES, 0):
        was, language.KEPT_BYTES = language.KEPT_BYTES, kept
        try:
            got = language.Scorer(model).logits(texts)
        finally:
            language.KEPT_BYTES = was
        for text, row in zip(texts, got):
            marked = [f"<{w}>" for w in text.lower().split()]
            ids = [bucket(w[i : i + n]) for w in marked for n in language.GRAMS for i in range(len(w) - n + 1)]
            want = model.embed[ids].astype(float).sum(0) / max(len(ids), 1) @ model.weight.astype(float) + model.bias
            assert np.abs(row - want).max() < 1e-4


def test_every_language_is_learned(spark):
    rows = spark.range(2100 * 9).selectExpr("id AS doc_id", "concat('word', id) AS text", "concat('l', id % 2100) AS lang")
    got = language.sample(rows)
    assert len({x for _, x in got}) > 2050 and len(got) < language.TRAIN_MOST


def test_language_learns_nothing_from_the_held_out_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    for name, lang in (("a", F.col("lang")), ("b", F.when(out, "xx").otherwise(F.col("lang")))):
        docs.withColumn("lang", lang).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    a, b = (sorted(map(tuple, language.op5(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b and len(a) == docs.count() and {r[1] for r in a} == {True, False}


def test_line_spread(spark, edges, none):
    docs = [(i, f"Shared  LINE\nown line {i}\n\nrare {i % 3}", "en", f"s{i}", 1) for i in range(9)]
    out = {r["doc_id"]: r for r in line_spread.clean_documents(spark.createDataFrame(docs, DOCS), keep_counts=True).collect()}
    first = min(range(9), key=lambda i: hashlib.md5(docs[i][1].encode()).digest())
    for i in range(9):
        assert out[i]["text"] == (docs[i][1] if i == first else f"own line {i}\n\nrare {i % 3}") and out[i]["n_lines"] == 4
    same = line_spread.clean_documents(edges)
    assert same.columns == edges.columns and sorted(map(repr, same.collect())) == sorted(map(repr, edges.collect()))
    assert line_spread.clean_documents(none).count() == 0


def test_bpe_is_the_librarys(spark, edges):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path())
    rng = np.random.default_rng(2)
    texts = [x[1] or "" for x in EDGES] + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    texts += ["".join(rng.choice(list("abcdeinorst'0é!"), int(n))) for n in rng.integers(1, 60, 3000)] + ["ab" * 20_000]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x) == ids and c.decode(ids) == t.decode(ids, skip_special_tokens=False)
    rows = bpe.encode_documents(edges, keep_ids=True).collect()
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in rows) and len(rows) == len(EDGES)


@pytest.mark.parametrize("kinds", [(), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 1, 0), (3, 0)])
def test_webp_round_trips(kinds):
    rng = np.random.default_rng(len(kinds))
    every = lambda px, bits: np.arange(np.prod(s := [-(-n >> bits) for n in px.shape[:2]])).reshape(s)
    side = {webp.PREDICTOR: lambda px, bits: every(px, bits) % 14, webp.CROSS: lambda px, bits: np.stack([every(px, bits) * k & 255 for k in (0, 37, 11, 5)], -1)}
    images, media = [], []
    for cache in (0, 4):
        for high, wide in ((1, 1), (5, 7), (19, 33)):
            px = rng.integers(0, 256, (12, 4))[rng.integers(0, 12, (high, wide))] if 3 in kinds else rng.integers(0, 256, (high, wide, 4))
            px[:, wide // 2 :] = px[:, :1]
            for chosen in (None, side):
                images.append(px)
                media.append(webp.encode(px, kinds, (cache,), side=chosen))
    for px, got, f in zip(images, webp.decode_all(media), media):  # in step with each other, and alone
        assert (got == px).all() and (webp.decode(f) == px).all()


def test_webp_reads_files_of_others():
    one = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")  # a public probe for lossless support: one clear pixel
    assert webp.decode(one).tolist() == [[[0, 0, 0, 0]]]
    w = webp.Writer()  # by hand: two groups of codes without a bit of pixels, dealt by an entropy image of 4 by 4 pixels a block
    for v, n in ((0x2F, 8), (7, 14), (3, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        w.put(v, n)
    webp._put_image(w, np.array([[[255, 0, 0, 0], [255, 0, 1, 0]]]), False)
    for group in ((10, 20, 30, 255, 0), (1, 2, 3, 4, 0)):  # green, red, blue, alpha, distance
        for symbol in group:
            webp.write_lengths(w, np.eye(1, 256, symbol, dtype=int)[0])
    px = webp.decode(webp._file(w.data()))
    assert px.shape == (4, 8, 4) and (px[:, :4] == [255, 20, 10, 30]).all() and (px[:, 4:] == [4, 2, 1, 3]).all()


def test_webp_makes_and_reads_many_codes_in_step():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 40, (60, 300)) * (rng.random((60, 300)) < rng.random((60, 1))) ** 2
    counts[0], counts[1], counts[2, 5:] = 0, np.eye(300, dtype=int)[7], 0
    counts[3, :30] = [1 << min(k, 25) for k in range(30)]  # deeper than 15 bits
    got = webp.code_lengths(counts, 15)
    assert ((got > 0) == (counts > 0)).all() and got.max() == 15
    for k, (c, n) in enumerate(zip(counts, got)):
        heap = sorted(c[c > 0].tolist())
        if len(heap) < 2:
            assert n.sum() == len(heap)
            continue
        assert (2.0 ** -n[n > 0]).sum() == 1
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert k == 3 or (c * n).sum() == cost
    codes = webp.canonical(got)
    for n, code, (table, bits) in zip(got[3:], codes[3:], webp._lookups(got[3:])):  # each code's bits find it, whatever follows
        for s in np.flatnonzero(n):
            assert bits == 0 or (table[np.arange(code[s], 1 << bits, 1 << n[s])] == s << 4 | n[s]).all()
    with pytest.raises(ValueError):
        webp._lookups(np.array([[1, 2, 0]]))
    px = np.concatenate([np.full((16, 192, 1), 255), rng.integers(0, 90, (16, 192, 3))], 2)
    file = webp.encode(px, (), (8,))
    for size in (25, 60, 200, 900, len(file) - 4):
        broken = webp._file(webp.chunk(file)[: size - 20])
        with pytest.raises(ValueError):
            webp.decode_all([file, broken])


def test_webp_picks_the_smallest():
    y, x = np.mgrid[:16, :192]
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (16, 192))
    opaque = lambda *c: np.stack([np.full((16, 192), 255), *c], -1) & 255
    first = lambda f: (lambda b: (webp._header(b), b.read(2) if b.read(1) else None)[1])(webp.Bits(webp.chunk(f)))
    some = {
        None: opaque(rng.integers(0, 20, (16, 192)), noise, rng.integers(0, 9, (16, 192))),
        webp.PREDICTOR: opaque(x * 3 + y * y + noise % 3, x * 5 + y + noise % 5 // 4, 255 - x - y * 3),
        webp.SUBTRACT: opaque(noise, noise, noise),
        webp.CROSS: opaque((noise + 128 & 255) - 128 >> 1, noise, rng.integers(0, 256, (16, 192))),
        webp.PALETTE: opaque(*rng.integers(0, 256, (3, 7))[:, rng.integers(0, 7, (16, 192))]),
    }
    assert webp.smallest_all(list(some.values())) == [webp.smallest_all([px])[0] for px in some.values()]
    for kind, px in some.items():
        f = webp.smallest_all([px])[0]
        assert first(f) == kind and (webp.decode(f) == px).all()


def test_webp_store(spark, edges, none):
    payloads = [webp.payload_of(x)[0] for x in (None, "a", "b" * 576, "ÿ" * 9000, "xyz " * 9000, "".join(map(chr, range(1, 2000))))]
    media = webp.store_all(payloads)
    assert media == [webp.store_all([p])[0] for p in payloads]
    assert [x.tobytes() for x in webp.load(media)] == payloads
    with pytest.raises(ValueError):
        webp.decode(media[3][:40])
    with pytest.raises(ValueError):
        webp.decode_all([media[1], media[3][: len(webp.files(media[3])[0]) // 2]])
    for r, (_, text, *_) in zip(webp.keep_texts(edges, media=True).collect(), EDGES):
        p, n = webp.payload_of(text)
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r["samples"], r["high"] * r["wide"] * 3) == (p, len(p)) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert webp.keep_texts(none).count() == 0


def components(prints, radius=4):
    values = np.array(prints, np.uint64)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= radius)
    return simhash._roots(len(values), a, b)


def test_simhash(spark, documents, edges, none):
    for docs in (documents, edges):
        rows = simhash.near_duplicates(docs).collect()
        root = components([int(r["fingerprint"], 16) for r in rows])
        low = {}
        for r, k in zip(rows, root):
            low[k] = min([x for x in (low.get(k), r["doc_id"]) if x is not None], default=None)
        assert [r["component_id"] for r in rows] == [low[k] for k in root]
    once = simhash.near_deduplicated(edges)
    assert once.columns == edges.columns and sorted(map(repr, [r["doc_id"] for r in once.collect()])) == sorted(map(repr, {r["component_id"] for r in rows}))
    assert simhash.near_duplicates(none).count() == 0 and simhash.fingerprint(None) == 0


def test_near_dedup_links_at_the_similarity_of_shingles(spark, documents, edges, none):
    rng = np.random.default_rng(6)
    rows = [(100 + d, t, "en", "a", 0) for d, t, *_ in (x for x in EDGES if x[0] is not None)] + [(None, "null id here", "fr", "b", 12)]
    for i in range(60):  # copies with 0 to 5 words changed, and chains of them
        w = rng.choice([f"w{k}" for k in range(500)], 120).tolist()
        for j in range(5):
            rows.append((1000 + 5 * i + j, " ".join(w), "en", "a", 0))
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(0, 120))] = f"x{rng.integers(0, 1 << 30)}"
    for docs in (spark.createDataFrame(rows, DOCS), documents):
        got = corpus_pipeline.near_dedup(spark, docs, SF)
        assert got.columns == docs.columns
        all_ = docs.collect()
        low = [words("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in all_]
        sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in low]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        root = simhash._roots(len(sets), *np.array(pairs).reshape(-1, 2).T)
        want = {k: min((r["doc_id"] for r, x in zip(all_, root) if x == k and r["doc_id"] is not None), default=None) for k in set(root.tolist())}
        assert sorted(map(repr, (r["doc_id"] for r in got.collect()))) == sorted(map(repr, want.values()))
    assert corpus_pipeline.near_dedup(spark, none, SF).count() == 0


def test_hot_buckets_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 12, np.uint64)
    flips = lambda n: (np.uint64(1) << rng.integers(0, 64, (n, 2), np.uint64)).sum(1, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ flips(40) for b in base]))
    fps = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    for hot in (16, 10_000):
        edges = simhash.linked(fps, hot=hot).collect()
        place = {int(x): i for i, x in enumerate(prints.view(np.int64))}
        root = simhash._roots(len(prints), np.array([place[e["u"]] for e in edges]), np.array([place[e["v"]] for e in edges]))
        assert (root == components(prints)).all()
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def test_license_rules(spark, edges, none):
    rules = licenses.rules()
    assert len(rules) > 200 and all(k == " under " or any(g in k for g in licenses.gate_words()) for _, k, *_ in rules)
    got = {r["doc_id"]: r for r in licenses.scan(edges).collect()}
    r = got[5]
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in EDGES[5][1]))
    places = [i for p in (["cc", "by"], ["all", "rights", "reserved"]) for i in range(len(w)) if w[i : i + len(p)] == p]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places), max(places))
    assert r["base_labels"] == "cc-by,reserved" and "mit" in r["labels"].split(",")
    assert got[1]["labels"] == "" and got[1]["first_word"] is None and licenses.scan(none).count() == 0
    text = "released under the terms of the GNU General Public License version 3 or later"
    found = [x["label"] for x in licenses.detections(spark.createDataFrame([("k", text)], "key string, text string").select("key", licenses._normal(F.col("text")).alias("form"))).collect()]
    assert found == ["gpl-3.0-or-later"] or set(found) <= {"gpl-3.0-or-later", "gpl-3.0"}


def test_sql_of_the_registered_queries(spark):
    from setwise.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        cols = sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()))


def test_what_bpe_remembers_is_bounded():
    codec = bpe.Codec(bpe.default_path())
    want = codec.encode_bytes("hello world")
    for a in range(0, 400_000, 50_000):
        codec.encode_bytes(" ".join(f"q{i:06x}" for i in range(a, a + 50_000)))
    assert len(codec.known) + len(getattr(codec, "older", ())) <= 250_000
    assert len(codec.vocab._fits) <= 200_000
    assert codec.encode_bytes("hello world") == want


def test_workers_give_memory_back():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) // 1024

    def run(batches):
        kept = []
        for batch in batches:
            parts = [bytearray(1000) for _ in range(150_000)]
            kept = parts[::1000]  # scattered, so that little goes back by itself
            del parts
            yield batch
        run.kept = kept

    before = held()
    list(common.tidy(run)([None]))
    assert held() - before < 50


def test_open_groups_of_near_copies_come_without_a_join(spark, monkeypatch):
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return common.materialise(df, name)

    monkeypatch.setattr(near_copies, "materialise", seen)
    own = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, own + " and more" * (i % 3)) for i in range(9)], "doc_id long, text string")
    got = near_copies.near_copies(docs).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]
    assert "members" not in plans and "Join" not in plans["open"]


def test_near_copies_fetch_few_sets_and_hold_no_text_twice(spark, monkeypatch):
    written = {}

    def seen(df, name):
        written[name] = common.materialise(df, name)
        return written[name]

    monkeypatch.setattr(near_copies, "materialise", seen)
    rng = np.random.default_rng(4)
    rows = [(i, [f"{i}w{k}" for k in range(80)]) for i in range(0, 120, 4)]
    for i, words in rows[:]:  # copies with changes of 4, 8 and 20 words, of which the last is no near copy
        rows += [(i + k, [f"x{rng.integers(1 << 30)}" if j % 80 in range(10, 10 + n) else w for j, w in enumerate(words)]) for k, n in ((1, 4), (2, 5), (3, 20))]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in rows] + [(0, " ".join(rows[0][1])), (None, " ".join(rows[0][1]))], "doc_id long, text string")
    got = {r[0]: r[1] for r in near_copies.near_copies(docs, most=40).select("doc_id", "component_id").collect()}
    sets = {i: near_copies.shingles(" ".join(words)) for i, words in rows}
    root = simhash._roots(120, *np.array([(i, j) for i in sets for j in sets if i < j and near_copies.similar(sets[i], sets[j])]).T)
    assert got == {i: root[i] for i in sets} | {None: 0} and len(set(got.values())) > 30
    assert "text" not in written["shingles"].columns
    sent = written["partners"].select("fp", "b")
    assert sent.count() == sent.select("fp").distinct().count()  # a set goes to one group, however many buckets it is in


def test_narrowed_groups_keep_every_pair():
    rng = np.random.default_rng(5)
    sets, group, root = [], [], []
    for g in range(60):
        of = rng.integers(0, 1 << 63, 400, np.uint64)
        a = int(rng.choice([4, 5, 9, 30, 200]))
        n = len(sets)
        sets += [np.sort(of[:a]), np.sort(of[: a + a // 4]), np.sort(of[a // 9 : a + a // 9])]
        sets += [np.sort(rng.integers(0, 1 << 63, a, np.uint64)) for _ in range(4)]
        group += [g] * 7
        root += [n, n + 1, n + 2, n + 3, n + 3, n + 5, n + 6]
    n = np.array([len(x) for x in sets])
    order = np.lexsort((n, group))
    sets, group, root, n = [sets[i] for i in order], np.array(group)[order], np.array(root)[order], n[order]
    wide = np.stack([near_copies.wide_simhash(x) for x in sets])
    first = near_copies.narrowed(group, root, n, np.ascontiguousarray(wide[:, 0]), wide)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if group[i] == group[j] and root[i] != root[j] and near_copies.similar(sets[i], sets[j])]
    assert len(pairs) > 60 and all(first[i] == first[j] for i, j in pairs)
    alone = [i for i in range(len(sets)) if not any(i in p for p in pairs)]
    assert (np.bincount(first)[first[alone]] == 1).mean() > 0.9
