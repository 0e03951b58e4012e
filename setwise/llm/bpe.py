"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

A piece (pre-token) is a string over 512 symbols: a byte inside the piece or a byte that ends it. An Aho-Corasick
automaton gives the longest token at each place; a token's longest proper prefix that is a token is the next choice. A token may follow another only
if no merge would have crossed the border between them, which a table of split halves and merge ranks answers (pair
compatibility). The encoder takes the longest compatible token, and steps back where none is left; each place is given
up at most once, so that time is linear in the piece. The result is that of applying the merges in rank order.

Words repeat, so a worker remembers the ids of short ones, up to CACHE words, and up to PAIRS borders between tokens.
When half of that is full, the words of the half before go; those that come again first move to the new half.

Defined results: null counts as the empty text, which has no tokens; the special tokens' strings in a text become
their ids, as the tokenizers library does; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from setwise.llm.common import table, tidy

#: White space of the Unicode standard, as the vocabulary file's patterns mean it.
BLANK = "\t-\r \x85\xa0  -     　"
NOT_BLANK = re.compile("[\x1c-\x1f]")
#: Words (of up to CACHED_CHARS characters) and pairs of tokens that a worker remembers: 0.15 kB each.
CACHE, CACHED_CHARS, PAIRS = 250_000, 48, 200_000


def _ranges(codes: Iterable[int]) -> str:
    """Code points as ranges of a character class."""
    out = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


@functools.cache
def newer_characters() -> tuple[str, str]:
    """Character classes of the code points that this Python's Unicode doesn't assign, and of those among them that the regex module has for letters or numbers and the tokenizers library, of another Unicode, doesn't."""
    from tokenizers import Regex, pre_tokenizers

    new = lambda: (c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")  # noqa: E731; never all at once: they take 100 MB
    letter = regex.compile(r"[\p{L}\p{N}]")
    named = [chr(c) for c in new() if letter.match(chr(c))]
    known = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str("".join(named))
    return _ranges(new()), _ranges(sorted(set(map(ord, named)) - {ord(c) for piece, _ in known for c in piece}))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Vocabulary:
    """Tokens as strings over symbols 0 to 511 (byte, or 256 + byte at a piece's end), merge halves, matcher, offsets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        places = {c: b for b, c in enumerate(byte_symbols())}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", BLANK)
        self.pattern = regex.compile(split)
        newer, beyond = newer_characters()
        self.newer = re.compile(f"[{newer}]")
        self.strict = regex.compile(regex.sub(r"\\p\{\w\}", lambda m: f"[{m[0]}--[{beyond}]]", split), regex.V1) if beyond else self.pattern

        def symbols(token: str) -> str:
            ends = token.endswith(self.end) and token != self.end
            own = [places[c] for c in (token[: -len(self.end)] if ends else token)]
            return "".join(map(chr, own[:-1] + [own[-1] + 256 * ends]))

        self.string = {i: symbols(t) for t, i in ids.items() if t not in self.special}
        self.rank: dict[tuple[int, int], int] = {}  # of a pair of ids
        self.born: dict[int, int] = {}  # rank of the merge that makes a token; -1: a symbol
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[left + right]
            self.rank[ids[left], ids[right]] = rank
            self.halves[made], self.born[made] = (ids[left], ids[right]), rank
        for i, s in self.string.items():
            if len(s) == 1:
                self.born[i] = -1
        of = {s: i for i, s in self.string.items() if i in self.born}
        self.of, self.length = of, {i: len(s) for s, i in of.items()}
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in of.items():
            self.matcher.add_word(s, i)
        self.matcher.make_automaton()
        self.packed = {i: struct.pack("<I", i) for i in of.values()}
        self.shorter: dict[int, int] = {}  # the longest proper prefix that is a token
        for s, i in of.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := of.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break
        self._fits: dict[tuple[int, int], bool] = {}
        # Decoding: every id's string and a space in one blob, and where each begins.
        strings = {**{i: t for t, i in ids.items()}, **{i: t for t, i in self.special.items()}}
        parts = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
        self.offsets = np.cumsum([0, *map(len, parts)])
        self.blob = np.frombuffer(b"".join(parts), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right as they are when one follows the other."""
        if (known := self._fits.get((left, right))) is not None:
            return known
        # Undo merges on both sides of the border, the latest first. A merge over the border would have come before
        # the merges undone so far on its own side; ties between equal ranks go to the pair on the left.
        a, b, before_a, before_b = left, right, 1 << 60, 1 << 60
        out = True
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < before_a and rank <= before_b:
                out = False
                break
            if self.born[a] < 0 and self.born[b] < 0:
                break
            if self.born[a] >= self.born[b]:
                before_a = self.born[a]
                a = self.halves[a][1]
            else:
                before_b = self.born[b]
                b = self.halves[b][0]
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        self._fits[left, right] = out
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of a piece in symbols."""
        out = [i for _, i in self.matcher.iter_long(piece)]  # the longest match at each place, if all of them fit
        known, k = self._fits, 0
        for pair in zip(out, out[1:]):
            k += 1
            if not (known[pair] if pair in known else self.fits(*pair)):
                return self._step_back(piece, out[:k])
        return out

    def _step_back(self, piece: str, out: list[int]) -> list[int]:
        """The ids of piece; out: those that fit so far, each the longest match at its place."""
        n, best, length, known = len(piece), [0] * len(piece), self.length, self._fits
        for end, i in self.matcher.iter(piece):  # matches that begin at one place come shortest first
            best[end + 1 - length[i]] = i
        dead = bytearray(n + 1)  # places from which nothing leads to the end
        at = sum([length[i] for i in out])
        token = best[at]
        while True:
            stop = at + length[token]
            if not dead[stop] and (not out or (known[pair] if (pair := (out[-1], token)) in known else self.fits(*pair))):
                out.append(token)
                at = stop
                if at == n:
                    return out
                token = best[at]
                continue
            nxt = self.shorter.get(token)
            while nxt is None:  # nothing shorter fits here: give the place up
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                nxt = self.shorter.get(last)
            token = nxt

    def piece_symbols(self, piece: str) -> str:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        return piece[:-1] + chr(ord(piece[-1]) + 256) if self.end else piece


class Codec:
    """encode and decode as the tokenizers library does with the vocabulary file, without truncation or padding."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, self.vocab.special), key=len, reverse=True)) + ")")
        self.blanks = re.compile(f"[{BLANK}]+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        """Composed and lower-case. Runs of white space stay: no piece holds white space."""
        if text.isascii():
            return text.lower()
        if not text.replace("\n", " ").isprintable() and self.vocab.newer.search(text):  # what is not assigned is not printable
            from tokenizers import normalizers

            return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHED_CHARS:
            if len(self.known) >= CACHE // 2:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if (got := self.older.get(piece)) is not None:
            return self._keep(piece, got)
        v = self.vocab
        return self._keep(piece, b"".join([v.packed[i] for i in v.encode_piece(v.piece_symbols(piece))]))

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        if (got := self.older.get(word)) is not None:
            return self._keep(word, got)
        known, v = self.known, self.vocab
        pieces = (v.pattern if word.isprintable() or not v.newer.search(word) else v.strict).findall(word)
        out = b"".join([known[x] if x in known else self._piece(x) for x in pieces])
        return self._keep(word, out) if len(word) < 8 else out

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.special.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(struct.pack("<I", self.vocab.special[part]))
                continue
            part = self.normal(part)
            # str.split also splits at 0x1C to 0x1F, which the patterns hold for symbols.
            known = self.known  # _keep may have begun another
            for word in self.blanks.split(part) if NOT_BLANK.search(part) else part.split():
                got = known.get(word)
                out.append(self._word(word) if got is None else got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """The tokens' strings, a space between two, in UTF-8: bytes of the blob, gathered by the offset table."""
        if not ids:
            return b""
        ids = np.frombuffer(ids, "<u4")
        start = self.vocab.offsets[ids]
        size = self.vocab.offsets[ids + 1] - start
        ends = np.cumsum(size, dtype=np.int64)
        place = np.repeat((start - ends + size).astype(np.int32) if ends[-1] < 1 << 31 else start - ends + size, size)
        place += np.arange(ends[-1], dtype=place.dtype)
        return self.vocab.blob[place].tobytes()[:-1]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, "<u4").tobytes()).decode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    """Found where it is used: on a worker, the worker's own."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text; keep_ids adds ids (binary, little-endian 32-bit) and decoded."""
    path = os.fspath(path) if path else None
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep_ids]

    def run(batches):
        c = codec(path or default_path())
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = c.encode_bytes(text.as_py() or "")
                decoded = c.decode_bytes(ids)
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids, decoded.decode()) if keep_ids else ())))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA + ", ids binary, decoded string" * keep_ids)


def op7(spark, sf_dir) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
