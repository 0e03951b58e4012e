"""Language identification by averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A word's subwords are its character n-grams of 1 to 4 (with marks at both ends), hashed to BUCKETS rows; a text is the
average of all its subwords' embeddings. As the model is linear in that average, a worker keeps each word's summed class
scores and scores every whole text by adding them up. Probabilities are calibrated by a temperature, and a rejection
threshold keeps accuracy on a validation part at PRECISION or more; `rejected` marks texts below it.

The classifier is fitted on a bounded sample of labelled rows (by hash, from texts of at most TRAIN_CHARS characters):
PER_LANG rows a language, fewer if TRAIN_ROWS rows in all would not do for that, but LEAST_LANG a language in any case
and TRAIN_MOST rows in all; WORDS random words of each in a pass.

Defined results: null texts and texts without a letter (Unicode category L) are `und` with score 0; equally likely
languages go to the first in order; without any labelled row every text is `und`; repeated rows each get a row; an empty
table gives an empty result; lang, source and doc_id are never inputs of a prediction, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setwise.llm.common import lookup, materialise, table

PER_LANG, TRAIN_ROWS, LEAST_LANG, TRAIN_MOST, TRAIN_CHARS, WORDS = 1000, 8000, 8, 64_000, 20_000, 32
BUCKETS, DIM, GRAMS, PASSES, RATE, SEED = 1 << 14, 16, (1, 2, 3, 4), 3, 0.5, 5
UPDATES, MIX = 400, (0x9E3779B1, 0x85EBCA77)
#: Bytes of class scores of words that a worker keeps, characters of a word that it keeps, words that it adds up at once.
PRECISION, KEPT_BYTES, KEPT_CHARS, TOGETHER = 0.995, 32 << 20, 48, 1 << 15
_LETTER = regex.compile(r"\p{L}")


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def marked(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of words, each between two marks, one word after the other, and the words' lengths with marks."""
    chars = np.frombuffer("".join([f"<{w}>" for w in found]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    return chars, np.fromiter(map(len, found), np.int64, len(found)) + 2


def subwords(chars: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first n places the ids of the n-grams that begin there, and which of them end within the word; left: characters from a place to its word's end."""
    total, ids, there = np.zeros(n, np.uint32), [], []
    chars = np.r_[chars, np.zeros(max(GRAMS), np.uint32)]
    for k in range(max(GRAMS)):
        total = (total ^ chars[k : k + n]) * np.uint32(MIX[0])
        total ^= total >> np.uint32(15)
        if k + 1 in GRAMS:
            ids.append((total * np.uint32(MIX[1] + 2 * k) >> np.uint32(16)) % BUCKETS)
            there.append(left[:n] > k)
    return np.stack(ids, 1), np.stack(there, 1)


def _to_end(size: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(size), size) - np.arange(size.sum())


def words(text: str) -> list[str]:
    return text.lower().split()


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(text, lang) of the bounded sample of docs (doc_id, text, lang), which holds training rows only."""
    rows = docs.where("text is not null and lang is not null").where(F.length("text") <= TRAIN_CHARS).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    sizes = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    want = max(LEAST_LANG, min(PER_LANG, TRAIN_ROWS // max(1, sizes.count())))
    share = F.pmod(F.shiftrightunsigned("h", 11), F.lit(1 << 20)) < F.lit(want * (1 << 20)) / F.col("n")
    got = lookup(rows, sizes, ["lang"], "inner").where(share).orderBy("h", "text", "lang").select("text", "lang").limit(TRAIN_MOST)
    return [(r[0], r[1]) for r in got.collect()]


class Model:
    """langs, embeddings, weights, bias, temperature, threshold; plain arrays, so that it travels to the workers."""

    def __init__(self, rows: list[tuple[str, str]], passes: int | None = None):
        rng = np.random.default_rng(SEED)
        self.langs = sorted({x[1] for x in rows})
        self.temperature, self.threshold, k = 1.0, 0.0, len(self.langs)
        self.embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.weight, self.bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
        if not k:
            return
        place = {x: i for i, x in enumerate(self.langs)}
        label = np.array([place[x[1]] for x in rows])
        order = rng.permutation(len(rows))
        held = order[: len(rows) // 10] if len(rows) >= 50 else order[:0]
        train = order[len(held) :]
        passes = passes or max(PASSES, UPDATES * 32 // len(rows))
        found = [words(x[0]) for x in rows]

        for step in range(passes):
            rate = RATE * (1 - step / passes)
            for at in range(0, len(train), 32):
                batch = train[at : at + 32]
                some = [[own[i] for i in rng.integers(0, len(own), min(len(own), WORDS))] if (own := found[j]) else [""] for j in batch]
                chars, length = marked([w for x in some for w in x])
                ids, there = subwords(chars, _to_end(length), len(chars))
                own = np.repeat(np.arange(len(batch)), [length[a:b].sum() for a, b in zip(*(lambda e: (np.r_[0, e[:-1]], e))(np.cumsum([len(x) for x in some])))])
                ids, own = ids[there], np.repeat(own, there.sum(1))
                size = np.bincount(own, minlength=len(batch))
                mean = np.add.reduceat(self.embed[ids], np.r_[0, np.cumsum(size)[:-1]]) / size[:, None]
                p = _softmax(mean @ self.weight + self.bias)
                p[np.arange(len(batch)), label[batch]] -= 1
                back = (p @ self.weight.T) / size[:, None]
                self.weight -= rate * mean.T @ p
                self.bias -= rate * p.sum(0) / len(batch)
                np.add.at(self.embed, ids, np.repeat(-rate * back, size, 0).astype(np.float32))
        if len(held):
            logits = Scorer(self).logits([rows[i][0] for i in held])
            loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), label[held]] + 1e-9).mean()
            self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
            p = _softmax(logits / self.temperature)
            top, right = p.max(1), p.argmax(1) == label[held]
            # The lowest threshold from which on predictions are right often enough.
            self.threshold = next((float(t) for t in np.sort(top) if right[top >= t].mean() >= PRECISION), 1.0)

    def predict(self, texts: list, scorer: Scorer | None = None) -> list[tuple[str, float, bool]]:
        """Language, calibrated probability, whether to reject it, of each text."""
        real = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        out = [("und", 0.0, True)] * len(texts)
        if real:
            p = _softmax((scorer or Scorer(self)).logits([texts[i] for i in real]) / self.temperature)
            for i, best, row in zip(real, p.argmax(1).tolist(), p):
                out[i] = (self.langs[best], float(min(1.0, row[best])), bool(row[best] < self.threshold))
        return out


class Scorer:
    """Class scores of whole texts; keeps the sums of words seen, up to KEPT_BYTES."""

    def __init__(self, model: Model):
        self.model, self.k = model, len(model.langs)
        self.scores = np.concatenate([(model.embed @ model.weight).astype(np.float64), np.ones((BUCKETS, 1))], 1)
        self._clear()

    def _clear(self):
        self.at, self.used, self.table = {}, 0, np.zeros((1024, self.k + 1))

    def _sums(self, found: list[str]) -> np.ndarray:
        """Of each word the sum of its n-grams' class scores, and their number."""
        chars, size = marked(found)
        left, own, out = _to_end(size), np.repeat(np.arange(len(size)), size), np.zeros((len(size), self.k + 1))
        step = max(64, (1 << 20) // (self.k + 1))  # a long word in parts
        for a in range(0, len(chars), step):
            n = min(step, len(chars) - a)
            ids, there = subwords(chars[a : a + n + max(GRAMS)], left[a:], n)
            each = sum(self.scores[ids[:, g]] * there[:, g, None] for g in range(len(GRAMS)))
            first = np.flatnonzero(np.diff(own[a : a + n], prepend=-1))
            out[own[a : a + n][first]] += np.add.reduceat(each, first)
        return out

    def _rows(self, found: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(found) if w not in self.at]
        if new:
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(new)] = self._sums(new)
            self.at.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        got = self.table[np.fromiter(map(self.at.__getitem__, found), np.int64, len(found))]
        for w in new:
            if len(w) > KEPT_CHARS:
                del self.at[w]
        if self.used * 8 * (self.k + 1) > KEPT_BYTES:
            self._clear()
        return got

    def logits(self, texts: list[str]) -> np.ndarray:
        out, waiting, owner, held = np.zeros((len(texts), self.k + 1)), [], [], 0
        together = max(64, TOGETHER * 8 // (self.k + 8))

        def flush():
            nonlocal waiting, owner, held
            if waiting:
                size = np.array([len(x) for x in waiting])
                got = np.add.reduceat(self._rows([w for x in waiting for w in x]), np.r_[0, np.cumsum(size)[:-1]])
                np.add.at(out, owner, got)
            waiting, owner, held = [], [], 0

        for i, text in enumerate(texts):
            found = words(text)
            for a in range(0, len(found), together):  # a long text in parts
                waiting.append(found[a : a + together])
                owner.append(i)
                held += len(waiting[-1])
                if held >= together:
                    flush()
        flush()
        return out[:, : self.k] / np.maximum(out[:, self.k :], 1) + self.model.bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs (doc_id, text)."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            got = [x for i in range(0, len(batch), 256) for x in model.predict(batch.column(1).slice(i, 256).to_pylist(), scorer)]
            cols = list(zip(*got)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op5(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fold(F.col("doc_id"), 4) == 2
    model = Model(sample(docs.where(~out).select("doc_id", "text", "lang")))
    return identify(docs, model).withColumn("held_out", F.coalesce(out, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "rejected")
