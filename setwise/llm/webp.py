"""Lossless WebP images as a store of bytes.

Reading: `decode_all` reads any lossless images, many in step with each other, a pixel of each at a time: prefix codes
(simple and normal, one group or many by an entropy image), literals, back-references with two-dimensional distances
and the colour cache; then it inverts predictor, cross-colour, subtract-green and palette transforms, and gives pixel
arrays. Side images (palettes, block modes, entropy images) go through the same loop.

Writing: `store_all` lays bytes out as red, green and blue of ACROSS opaque pixels a row, ROWS rows an image. An image is
written with the transform that makes it smallest: none, subtract-green, predictor, cross-colour or palette, by an
estimate of their entropy, and for those near the best by their real size; each with back-references to the latest
place of the same three pixels and with the size of colour cache that costs least.

op8's defined results: a null text is empty and stored as one row of 255s; equal texts give equal values; repeated rows
each get a row; texts of any length are stored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from setwise.llm.common import table

WIDE, ROWS, FILL = 576, 16, 255
ACROSS, BLOCK_BITS, CACHES = WIDE // 3, 4, (0, 8)
#: Predictors that the writer tries; factors of the hash of three pixels.
MODES, MIX = (1, 2, 4, 7, 10, 11, 12, 13), (0x9E3779B1, 0x85EBCA77)
#: Images that are decoded in step, and that are written together.
AT_ONCE, WRITTEN = 4096, 128
#: A transform is tried in full if its estimate is at most so many times the best one.
NEARLY = 1.05
#: Fixed values of the format: order in which lengths of code lengths stand, and offsets (x, y) of the short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)
_DX, _DY = (np.array(x) for x in zip(*NEAR))


class Bits:
    """Reads bits, the lowest first."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def peek(self, n: int) -> int:
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 6], "little") >> (self.pos & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.pos += n
        if self.pos > 8 * len(self.data):
            raise ValueError("image data ends too early")
        return out


def _reverse(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, symbol and length of all lengths above 0, each row's by length and then by symbol."""
    row, symbol = np.nonzero(lengths)
    key = np.sort(row << 16 | lengths[row, symbol] << 12 | symbol)
    return key >> 16, key & 0xFFF, key >> 12 & 15


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol of each row (a code's lengths), bits in the order in which they are written."""
    row, symbol, n = _by_length(lengths)
    codes, size = np.zeros(lengths.shape, np.int64), 1 << (15 - n)
    before = np.cumsum(size) - size
    codes[row, symbol] = _mirror(15)[before - before[np.searchsorted(row, row)]]
    return codes


def _tables(lengths: np.ndarray, bits: int) -> np.ndarray:
    """For each row (a code's lengths, none above bits) symbol << 4 | length for every next `bits` bits. A lone symbol takes no bits."""
    row, symbol, n = _by_length(lengths)
    lone = np.bincount(row, minlength=len(lengths))[row] == 1
    n = np.where(lone, 0, n)
    size = 1 << (bits - n)
    if (np.bincount(row, size, len(lengths)) != 1 << bits).any():
        raise ValueError("prefix code is not complete")
    return np.repeat((symbol << 4 | n).astype(np.uint16), size).reshape(len(lengths), -1)[:, _mirror(bits)]


def _lookups(lengths: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """A table as of _tables for each row, and the bits that it is for: its longest code's."""
    bits = np.where(np.count_nonzero(lengths, 1) == 1, 0, lengths.max(1))
    out: list = [None] * len(bits)
    for n in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == n)
        for k, t in zip(rows.tolist(), _tables(lengths[rows], n)):
            out[k] = t, n
    return out


_MIRRORS: dict[int, np.ndarray] = {}


def _mirror(bits: int) -> np.ndarray:
    if bits not in _MIRRORS:
        x = np.arange(1 << bits)
        _MIRRORS[bits] = sum((((x >> k) & 1) << (bits - 1 - k) for k in range(bits)), 0 * x)
    return _MIRRORS[bits]


#: Of the symbols of code lengths: the fewest that one stands for, and the bits that say how many more.
FEWEST, MORE = np.array([1] * 16 + [3, 3, 11]), np.array([0] * 16 + [2, 3, 7])


def _words(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 32 bits from each byte on of all data behind each other, and the bit at which each begins and ends; the slack is more than the codes or 32 pixels of broken data run past the end."""
    start, parts, at = {}, [], 0
    for x in data:
        if id(x) not in start:
            start[id(x)] = at
            parts.append(x)
            at += len(x) + 8
    flat = np.frombuffer(b"".join(x + b"\0" * 8 for x in parts) + b"\0" * 8192, np.uint8).astype(np.uint32)
    begin = np.array([8 * start[id(x)] for x in data])
    return flat[:-3] | flat[1:-2] << 8 | flat[2:-1] << 16 | flat[3:] << 24, begin, begin + 8 * np.array([len(x) for x in data])


def _read_lengths(word: np.ndarray, pos: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Lengths of a code at each place pos, of as many symbols as alphabet says (a row each), in step with each other; pos moves behind them."""

    def take(i, n):
        p = pos[i]
        pos[i] = p + n
        return word[p >> 3] >> (p & 7) & ((1 << n) - 1)

    out = np.zeros((len(pos), int(alphabet.max())), np.int64)
    simple = take(np.arange(len(pos)), 1) == 1
    i = np.flatnonzero(simple)
    if len(i):
        two, wide = take(i, 1), take(i, 1)
        for lanes, n in ((i, np.where(wide, 8, 1)), (i[two == 1], 8)):
            symbol = take(lanes, n)
            if (symbol >= alphabet[lanes]).any():
                raise ValueError("symbol beyond its alphabet")
            out[lanes, symbol] = 1
    i = np.flatnonzero(~simple)
    if not len(i):
        return out
    many = 4 + take(i, 4)
    p = pos[i, None] + 3 * np.arange(19)
    own = np.zeros((len(i), 19), np.int64)
    own[:, LENGTH_ORDER] = np.where(np.arange(19) < many[:, None], word[p >> 3] >> (p & 7) & 7, 0)
    pos[i] += 3 * many
    table_, limit = _tables(own, 7).ravel(), alphabet[i]
    left = limit.copy()
    bounded = np.flatnonzero(take(i, 1))
    if len(bounded):
        left[bounded] = 2 + take(i[bounded], 2 + 2 * take(i[bounded], 3))
    lane, p, at, last = np.arange(len(i)), pos[i], np.zeros(len(i), np.int64), np.full(len(i), 8)
    values, times, sums = [], [], np.zeros(len(i), np.int64)
    while len(lane):
        bits = word[p >> 3] >> (p & 7)
        got = table_[lane << 7 | bits & 127]
        s, n = (got >> 4).astype(np.int64), got & 15
        more = MORE[s]
        often = FEWEST[s] + (bits >> n & ((1 << more) - 1))
        p = p + n + more
        value = np.where(s < 16, s, np.where(s == 16, last, 0))
        last = np.where(value > 0, value, last)
        at, left = at + often, left - 1
        for x, y in ((values, value), (times, often)):
            x.append(np.zeros(len(i), np.int16))
            x[-1][lane] = y
        live = (at < limit) & (left > 0)
        if not live.all():
            if (at > limit).any():
                raise ValueError("too many code lengths")
            pos[i[lane[~live]]], sums[lane[~live]] = p[~live], at[~live]
            lane, p, at, left, last, limit = (x[live] for x in (lane, p, at, left, last, limit))
    full = np.zeros((len(i), out.shape[1]), np.int64)
    full[np.arange(out.shape[1]) < sums[:, None]] = np.repeat(np.stack(values, 1).ravel(), np.stack(times, 1).ravel())
    out[i] = full
    return out


def _read_codes(asked: list) -> list:
    """The codes (as of _lookups) at a bit of each data, of alphabets asked for, and where they end: a code of each at a time."""
    word, begin, end = _words([x[0] for x in asked])
    pos, count = begin + [x[1] for x in asked], np.array([len(x[2]) for x in asked])
    out: list = [[] for _ in asked]
    for k in range(int(count.max())):
        i = np.flatnonzero(count > k)
        p = pos[i]
        lengths = _read_lengths(word, p, np.array([asked[j][2][k] for j in i]))
        pos[i] = p
        if (pos > end).any():
            raise ValueError("image data ends too early")
        for j, code in zip(i.tolist(), _lookups(lengths)):
            out[j].append(code)
    return list(zip(out, (pos - begin).tolist()))


# Reading


def _asked(b: Bits, wide: int, high: int, top: bool):
    """Asks for the codes and then the pixels of an entropy-coded image at b. top: it may have groups of codes."""
    bits = b.read(4) if b.read(1) else 0
    which, shift = None, 0
    if top and b.read(1):
        shift = b.read(3) + 2
        which = (yield from _asked(b, -(-wide >> shift), -(-high >> shift), False)).astype(np.int64) >> 8 & 0xFFFF
    n = 1 if which is None else int(which.max()) + 1
    codes, b.pos = yield _read_codes, b.data, b.pos, [280 + (1 << bits if bits else 0), 256, 256, 256, 40] * n
    argb, b.pos = yield _in_step, b.data, b.pos, wide, high, which, shift, codes, bits
    return argb


def _parsed(file: bytes):
    """Asks for the images of a file; gives its size, the transforms to undo in the order read, and the pixels that they left."""
    b = Bits(chunk(file))
    wide, high = _header(b)
    full, out, done = wide, [], set()
    while b.read(1):
        kind = b.read(2)
        if kind in done:
            raise ValueError("a transform stands twice")
        done.add(kind)
        if kind in (PREDICTOR, CROSS):
            bits = b.read(3) + 2
            w, h = -(-wide >> bits), -(-high >> bits)
            out.append((kind, wide, bits, _channels((yield from _asked(b, w, h, False)), h, w)))
        elif kind == PALETTE:
            n = b.read(8) + 1
            colours = np.zeros((256, 4), np.int64)  # an index beyond the palette is transparent black
            colours[:n] = np.cumsum(_channels((yield from _asked(b, n, 1, False)), 1, n)[0], 0) & 255
            out.append((kind, wide, _bundle(n), colours))
            wide = -(-wide >> _bundle(n))
        else:
            out.append((kind, wide, 0, None))
    argb = yield from _asked(b, wide, high, True)
    return full, high, out, argb.astype("<u4").view(np.uint8).reshape(high, wide, 4)[..., ::-1]


def _in_step(asked: list) -> list:
    """The pixels (as ARGB numbers) and the end of each image asked for: a pixel of each at a time. The largest come first, so that those not yet at their end are the first ones."""
    sizes = np.array([x[2] * x[3] for x in asked])
    ranks = np.argsort(-sizes, kind="stable")
    asked = [asked[k] for k in ranks]
    word, begin, end = _words([x[0] for x in asked])
    codes = [c for x in asked for c in x[6]]
    table_ = np.concatenate([t for t, _ in codes])
    ends_of = np.cumsum([len(t) for t, _ in codes])
    all_off = np.ascontiguousarray((ends_of - [len(t) for t, _ in codes]).reshape(-1, 5).T)
    all_mask = np.ascontiguousarray(np.array([(1 << n) - 1 for _, n in codes]).reshape(-1, 5).T)
    groups = np.array([len(x[6]) // 5 for x in asked])
    first_group = np.cumsum(groups) - groups
    off, mask = all_off[:, first_group], all_mask[:, first_group]
    used = [bool(m.any()) for m in all_mask]
    wide_, total = np.array([x[2] for x in asked]), sizes[ranks]
    home = np.cumsum(total) - total
    pixels, at = np.zeros(int(total.sum()), np.uint32), home.copy()
    maps = [x[4] if x[4] is not None else np.zeros(0, np.int64) for x in asked]
    which, map_at, shift = np.concatenate(maps), np.cumsum([0, *map(len, maps)])[:-1], np.array([x[5] for x in asked])
    across, many = -(-wide_ >> shift), np.flatnonzero([len(m) > 0 for m in maps])
    bits = np.array([x[7] for x in asked])
    places = np.where(bits > 0, 1 << bits, 0)
    cache, cache_at = np.zeros(int(places.sum()), np.uint32), np.cumsum(places) - places
    with_cache = np.flatnonzero(bits > 0)
    from_cache, down = cache_at[with_cache], (32 - bits[with_cache]).astype(np.uint32)
    pos, left, back = begin + [x[1] for x in asked], np.zeros(len(asked), np.int64), np.ones(len(asked), np.int64)

    def symbols(i, k, p):
        """Symbols of the k-th code of lanes i at p, and their lengths."""
        got = table_[off[k][i] + (word[p >> 3] >> (p & 7) & mask[k][i])]
        return (got >> 4).astype(np.int64), got & 15

    def extended(s, p):
        """Lengths or distances from their prefix symbols and the extra bits at p, and the number of these."""
        extra = np.maximum(s - 2, 0) >> 1
        more = word[p >> 3] >> (p & 7) & ((1 << extra) - 1)
        return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + more + 1), extra

    lanes = np.searchsorted(-total, -np.arange(int(total.max())))  # those with a pixel at this step
    for step, n in enumerate(lanes.tolist()):
        if len(many):
            many = many[: np.searchsorted(many, n)]
            y, x = np.divmod(step, wide_[many])
            group = first_group[many] + which[map_at[many] + (y >> shift[many]) * across[many] + (x >> shift[many])]
            off[:, many], mask[:, many] = all_off[:, group], all_mask[:, group]
        value, busy = np.zeros(n, np.uint32), left[:n]
        i = np.flatnonzero(busy == 0)
        if len(i):
            p = pos[i]
            s, size = symbols(i, 0, p)
            p += size
            literal = s < 256
            all_plain = literal.all()
            plain, q, argb = (i, p, s << 8) if all_plain else (i[literal], p[literal], s[literal] << 8)
            for k, up in ((1, 16), (2, 0), (3, 24)):
                if used[k]:
                    got, size = symbols(plain, k, q)
                    q += size
                else:
                    got = (table_[off[k][plain]] >> 4).astype(np.int64)  # codes that take no bits
                argb |= got << up
            value[plain] = argb
            if all_plain:
                pos[i] = q
            else:
                p[literal] = q
                hit = s >= 280
                j = i[hit]
                value[j] = cache[cache_at[j] + s[hit] - 280]
                copy = (s >= 256) & ~hit
                if copy.any():
                    j, q = i[copy], p[copy]
                    long, size = extended(s[copy] - 256, q)
                    q += size
                    code, size = symbols(j, 4, q)
                    q += size
                    code, size = extended(code, q)
                    p[copy] = q + size
                    near_ = np.minimum(code, 120) - 1
                    left[j], back[j] = long, np.where(code > 120, code - 120, np.maximum(1, _DX[near_] + _DY[near_] * wide_[j]))
                    if (back[j] > step).any() or (step + long > total[j]).any():
                        raise ValueError("back-reference outside the image")
                pos[i] = p
        j = np.flatnonzero(busy)
        if len(j):
            value[j] = pixels[at[j] - back[j]]
            left[j] -= 1
        pixels[at[:n]] = value
        if len(with_cache):
            if n <= with_cache[-1]:
                k = np.searchsorted(with_cache, n)
                with_cache, from_cache, down = with_cache[:k], from_cache[:k], down[:k]
            v = value[with_cache]
            cache[from_cache + (v * np.uint32(CACHE_FACTOR) >> down)] = v
        at[:n] += 1
        if step % 32 == 31 and (pos > end).any():  # a broken image runs into the slack at most, until its end shows it
            raise ValueError("image data ends too early")
    if (pos > end).any():
        raise ValueError("image data ends too early")
    out: list = [None] * len(asked)
    for k, a, t, p in zip(ranks.tolist(), home.tolist(), total.tolist(), (pos - begin).tolist()):
        out[k] = pixels[a : a + t], p
    return out


def _channels(argb: np.ndarray, high: int, wide: int) -> np.ndarray:
    return np.stack([argb.astype(np.int64) >> k & 255 for k in (24, 16, 8, 0)], -1).reshape(high, wide, 4)


def _guess(mode: int, l, t, tl, tr, axis: int = -1):
    """The prediction from the left, top, top-left and top-right pixels (arrays; axis: that of the channels)."""
    mean = lambda a, b: (a + b) >> 1
    if mode in (1, 2, 3, 4):
        return (l, t, tr, tl)[mode - 1]
    if mode == 5:
        return mean(mean(l, tr), t)
    if mode in (6, 7, 8, 9):
        return mean(*((l, tl), (l, t), (tl, t), (t, tr))[mode - 6])
    if mode == 10:
        return mean(mean(l, tl), mean(t, tr))
    if mode == 11:
        to_left, to_top = np.abs(t - tl).sum(axis, keepdims=True), np.abs(l - tl).sum(axis, keepdims=True)
        return np.where(to_left < to_top, l, t)
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        m = mean(l, t)
        d = m - tl
        return np.clip(m + ((d + (d < 0)) >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), l.shape)


def _add_predictions(px: np.ndarray, tall: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Inverts the predictor of many images (images, rows, columns, channels), the tallest first, a pixel of each at a time."""
    out = px.copy()
    out[:, 0, 0, 0] += 255
    out[:, 0] = np.cumsum(out[:, 0], 1) & 255
    for y in range(1, px.shape[1]):
        n = int((tall > y).sum())
        above = out[:n, y - 1]
        out[:n, y, 0] = (out[:n, y, 0] + above[:, 0]) & 255
        for x in range(1, px.shape[2]):
            if x == 1 or x & ((1 << bits) - 1) == 0:
                own = modes[:n, y >> bits, x >> bits]
                sets = [(int(m), np.flatnonzero(own == m)) for m in np.unique(own)]
            right = above[:, x + 1] if x + 1 < px.shape[2] else out[:n, y, 0]
            for m, i in sets:
                out[i, y, x] = (out[i, y, x] + _guess(m, out[i, y, x - 1], above[i, x], above[i, x - 1], right[i])) & 255
    return out


def _cross(px: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """sign 1 adds, -1 takes what green and red say of red and blue; elements: a row of factors for each block."""
    signed = lambda x: ((x + 128) & 255) - 128
    high, wide = px.shape[-3:-1]
    e = signed(elements[..., np.arange(high)[:, None] >> bits, np.arange(wide)[None] >> bits, :])
    out, green = px.copy(), signed(px[..., 2])
    delta = lambda t, c: (t * c) >> 5
    out[..., 1] = (px[..., 1] + sign * delta(e[..., 3], green)) & 255
    red = out[..., 1] if sign > 0 else px[..., 1]
    out[..., 3] = (px[..., 3] + sign * (delta(e[..., 2], green) + delta(e[..., 1], signed(red)))) & 255
    return out


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _header(b: Bits):
    if b.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    wide, high, _, version = b.read(14) + 1, b.read(14) + 1, b.read(1), b.read(3)
    if version:
        raise ValueError("unknown version")
    return wide, high


def _undone(parts: list) -> list[np.ndarray]:
    """The pixels of images (full width, rows, transforms, coded pixels), those of like transforms together."""
    alike, out = defaultdict(list), [None] * len(parts)
    for k, (full, _, transforms, px) in enumerate(parts):
        alike[full, px.shape[1], tuple(x[:3] for x in transforms)].append(k)
    for (_, _, shape), ks in alike.items():
        if not shape:
            for k in ks:
                out[k] = parts[k][3]
            continue
        ks.sort(key=lambda k: -parts[k][1])
        tall = np.array([parts[k][1] for k in ks])

        def together(arrays):
            got = np.zeros((len(arrays), max(len(x) for x in arrays), *arrays[0].shape[1:]), np.int64)  # noqa: B023
            for i, x in enumerate(arrays):
                got[i, : len(x)] = x
            return got

        px = together([parts[k][3] for k in ks])
        for j in reversed(range(len(shape))):
            kind, wide, bits = shape[j]
            data = None if kind == SUBTRACT else together([parts[k][2][j][3] for k in ks])
            if kind == PREDICTOR:
                px = _add_predictions(px, tall, data[..., 2], bits)
            elif kind == CROSS:
                blocks = -(-px.shape[1] >> bits)
                px = _cross(px, np.pad(data, ((0, 0), (0, blocks - data.shape[1]), (0, 0), (0, 0))), bits, 1)
            elif kind == SUBTRACT:
                px[..., [1, 3]] = (px[..., [1, 3]] + px[..., 2:3]) & 255
            else:
                x = np.arange(wide)
                index = px[:, :, x >> bits, 2] >> ((x & (1 << bits) - 1) * (8 >> bits)) & ((1 << (8 >> bits)) - 1)
                px = data[np.arange(len(ks))[:, None, None], index]
        for i, k in enumerate(ks):
            out[k] = px[i, : parts[k][1]].astype(np.uint8)
    return out


def chunk(file: bytes) -> bytes:
    """The lossless chunk's data of a WebP file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return file[20 : 20 + int.from_bytes(file[16:20], "little")]


def decode_all(files_: list[bytes]) -> list[np.ndarray]:
    """Pixels (rows, columns, alpha red green blue) of lossless WebP files."""
    out, waiting = [None] * len(files_), []

    def go_on(k, parser, answer):
        try:
            waiting.append((k, parser, parser.send(answer)))
        except StopIteration as e:
            out[k] = e.value

    for k, f in enumerate(files_):
        go_on(k, _parsed(f), None)
    while waiting:
        now, waiting = waiting, []
        for read in (_read_codes, _in_step):
            own = [x for x in now if x[2][0] is read]
            for (k, parser, _), answer in zip(own, read([x[2][1:] for x in own]) if own else ()):
                go_on(k, parser, answer)
    return _undone(out)


def decode(file: bytes) -> np.ndarray:
    return decode_all([file])[0]


# Writing


class Writer:
    """Fields of up to 32 bits, the lowest bit first."""

    def __init__(self):
        self.parts, self.own = [], ([], [])

    def put(self, value: int, n: int):
        self.own[0].append(value)
        self.own[1].append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray):
        self.parts += [(np.array(self.own[0], np.uint64), np.array(self.own[1], np.int64)), (values.astype(np.uint64), sizes)]
        self.own = ([], [])

    def data(self) -> bytes:
        self.put_all(np.zeros(0), np.zeros(0, np.int64))
        values, sizes = (np.concatenate(x) for x in zip(*self.parts))
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        at = ends - sizes
        first = np.flatnonzero(np.diff(at >> 5, prepend=-1))
        sums = np.add.reduceat(values << (at & 31).astype(np.uint64), first)  # fields share no bit
        out, words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64), at[first] >> 5
        out[words] += sums & np.uint64(0xFFFFFFFF)
        out[words + 1] += sums >> np.uint64(32)
        return out.astype("<u4").tobytes()[: -(-int(ends[-1]) // 8)]


def _depths(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Depth of each symbol in the tree of each row's counts, in step with each other. n: symbols of each row, two or more, the most first."""
    rows, most, far = len(n), int(n[0]), 1 << 60
    row, symbol = np.nonzero(counts)
    key = np.sort(row << 40 | counts[row, symbol] << 12 | symbol)  # an image has at most 1 << 28 pixels
    row, symbol = key >> 40, key & 0xFFF
    leaf = (np.arange(len(row)) - (np.cumsum(n) - n)[row]) * rows + row
    # Two queues: leaves by count, and nodes in the order made, which is by count as well.
    nodes = (most + 1) * rows
    weight, parent = np.full((2 * most + 1) * rows, far + 1), np.zeros((2 * most + 1) * rows, np.int64)
    weight[:nodes] = far  # of leaves that a row lacks
    weight[leaf] = key >> 12 & ((1 << 28) - 1)
    lane = np.arange(rows)
    one, other, busy = lane.copy(), lane + nodes, np.searchsorted(-n, -np.arange(1, most + 1)).tolist()  # rows that make a node yet
    for made in range(most - 1):
        k, sums = busy[made], 0
        one, other, begin = one[:k], other[:k], nodes + made * rows
        for _ in range(2):
            a, b = weight[one], weight[other]
            first = a <= b
            parent[np.where(first, one, other)] = begin + lane[:k]
            sums = sums + np.minimum(a, b)
            ahead = first * rows
            one = one + ahead
            other = other + (rows - ahead)
        weight[begin : begin + k] = sums
    depth = np.zeros(len(parent), np.int64)
    for made in range(most - 3, -1, -1):  # roots stay 0
        k, begin = busy[made + 1], nodes + made * rows
        depth[begin : begin + k] = depth[parent[begin : begin + k]] + 1
    out = np.zeros(counts.shape, np.int64)
    out[row, symbol] = depth[parent[leaf]] + 1
    return out


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for the symbols with counts in each row, none above most."""
    counts = counts.astype(np.int64)
    out, n = np.minimum(counts, 1), np.count_nonzero(counts, 1)
    rows = np.flatnonzero(n > 1)
    rows = rows[np.argsort(-n[rows], kind="stable")]
    while len(rows):
        out[rows] = _depths(counts[rows], n[rows])
        rows = rows[out[rows].max(1) > most]
        counts[rows] = (counts[rows] + 1) // 2
    return out


def _length_tokens(flat: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of codes' lengths (code: which one's) the symbols (lengths, and runs by 16 to 18), their extra bits, the number of these and which code's they are."""
    first = np.flatnonzero((np.diff(flat, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    v, n, code = flat[first], np.diff(np.r_[first, len(flat)]), code[first]
    rest, most = n - (v > 0), np.where(v > 0, 6, 138)  # a length itself, then repeats of it; zeros from the first
    whole, left = rest // most, rest % most
    tail = np.where(left >= 3, 1, left)
    tokens = (v > 0) + whole + tail
    run = np.repeat(np.arange(len(v)), tokens)
    k = np.arange(len(run)) - np.repeat(np.cumsum(tokens) - tokens, tokens) - (v > 0)[run]  # -1: the length itself
    value, size = v[run], np.where(k < whole[run], most[run], left[run])
    repeats = (k >= 0) & ((k < whole[run]) | (left[run] >= 3))
    symbol = np.where(repeats, np.where(value > 0, 16, np.where(size > 10, 18, 17)), value)
    extra = np.where(repeats, size - np.where(symbol == 18, 11, 3), 0)
    bits = np.where(repeats, np.select([symbol == 16, symbol == 17], [2, 3], 7), 0)
    return symbol, extra, bits, code[run]


def _length_fields(lengths: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and sizes of the fields that write each row's lengths (of as many symbols as alphabet says), and the number of each row's: one or two symbols below 256 as a simple code, else run by run under a code of their own."""
    used, there = np.count_nonzero(lengths, 1), lengths > 0
    simple = (used <= 2) & ~there[:, 256:].any(1)
    some, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
    inside = np.arange(lengths.shape[1]) < alphabet[rest, None]
    symbols, extra, wide, code = _length_tokens(lengths[rest][inside], np.repeat(np.arange(len(rest)), alphabet[rest]))
    own = code_lengths(_counts(code, symbols, len(rest), 19), 7)
    tokens, count = np.bincount(code, minlength=len(rest)), np.full(len(lengths), 5)
    count[rest] = 22 + 2 * tokens
    begin = np.cumsum(count) - count
    values, sizes = np.zeros((2, int(count.sum())), np.int64)
    at = begin[some, None] + np.arange(5)
    first, last = there[some].argmax(1), there.shape[1] - 1 - there[some, ::-1].argmax(1)
    values[at] = np.stack([np.ones_like(some), used[some] == 2, np.ones_like(some), first, last], 1)
    sizes[at] = np.stack([np.ones_like(some)] * 3 + [np.full_like(some, 8), np.where(used[some] == 2, 8, 0)], 1)
    ordered = own[:, LENGTH_ORDER]
    many = np.maximum(4, 19 - (ordered[:, ::-1] > 0).argmax(1))
    at = begin[rest, None] + np.arange(22)
    values[at[:, 1]], values[at[:, 2:21]] = many - 4, ordered
    sizes[at[:, [0, 21]]], sizes[at[:, 1]], sizes[at[:, 2:21]] = 1, 4, 3 * (np.arange(19) < many[:, None])
    at = begin[rest][code] + 22 + 2 * (np.arange(len(code)) - (np.cumsum(tokens) - tokens)[code])
    codes, long = canonical(own), own * (np.count_nonzero(own, 1) > 1)[:, None]
    values[at], values[at + 1] = codes[code, symbols], extra
    sizes[at], sizes[at + 1] = long[code, symbols], wide
    return values, sizes, count


def write_lengths(w: Writer, lengths: np.ndarray):
    w.put_all(*_length_fields(lengths[None], np.array([len(lengths)]))[:2])


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra bits and their number for lengths or distances."""
    v = value - 1
    extra = np.maximum(np.frexp(v.astype(float))[1].astype(np.int64) - 2, 0)
    small = value <= 4
    return np.where(small, v, 2 * extra + 2 + (v >> extra & 1)), np.where(small, 0, v & ((1 << extra) - 1)), np.where(small, 0, extra)


_CODES: dict[int, np.ndarray] = {}


def _distance_codes(wide: int, back: np.ndarray) -> np.ndarray:
    if wide not in _CODES:
        if len(_CODES) > 64:
            _CODES.clear()
        codes = np.zeros(8 * wide + 9, np.int64)
        codes[np.maximum(1, _DX + _DY * wide)[::-1]] = np.arange(120, 0, -1)
        _CODES[wide] = codes
    known = _CODES[wide]
    got = known[np.minimum(back, len(known) - 1)]
    return np.where((back < len(known)) & (got > 0), got, back + 120)


def _latest(key: np.ndarray) -> np.ndarray:
    """For each place the latest one before it with the same key, else -1."""
    order = np.argsort(key, kind="stable")
    out = np.full(len(key), -1)
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _copies(argb: np.ndarray, image: np.ndarray, end: np.ndarray, most: int = 4096) -> tuple[np.ndarray, ...]:
    """Place, pixels and distance of back-references, greedily from each image's start: to the latest place where the same three pixels stand. image: each pixel's; end: of each image."""
    if len(argb) < 4:
        return (np.zeros(0, np.int64),) * 3
    key = ((argb[:-2] * np.uint32(MIX[0])) ^ (argb[1:-1] * np.uint32(MIX[1])) ^ (argb[2:] * np.uint32(CACHE_FACTOR))) >> np.uint32(16)
    before = _latest(key | image[:-2].astype(np.uint32) << np.uint32(16))
    place = np.flatnonzero((before >= 0) & (image[2:] == image[:-2]))
    for k in range(3):  # not by chance of the key
        place = place[argb[place + k] == argb[before[place] + k]]
    out, at = [], 0
    for i, j, n in zip(place.tolist(), before[place].tolist(), end[image[place]].tolist()):
        if i < at:
            continue
        size = 16
        while True:  # as long as both go on alike
            size = min(size, n - i, most)
            other = argb[i : i + size] != argb[j : j + size]
            k = int(other.argmax())
            if other[k] or size in (n - i, most):
                k = k if other[k] else size
                break
            size *= 8
        out.append((i, k, i - j))
        at = i + k
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _bits_of(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """About the bits that the symbols with the counts of each row take, with their codes; first: where each code's counts begin."""
    logs = counts * np.log2(np.maximum(counts, 1))
    total = np.add.reduceat(counts, first, 1)
    return (total * np.log2(np.maximum(total, 1))).sum(1) - logs.sum(1) + 4.0 * np.count_nonzero(counts, axis=1)


_FIRST = np.arange(0, 1024, 256)


def _counts(which: np.ndarray, symbols: np.ndarray, images: int, alphabet: int) -> np.ndarray:
    """How often each image (which: of each symbol) has each symbol."""
    return np.bincount(which * alphabet + symbols, minlength=images * alphabet).reshape(images, alphabet)


def _channel_counts(which: np.ndarray, px: np.ndarray, images: int) -> np.ndarray:
    """How often each image has each value of alpha, red, green, blue."""
    px = px.reshape(-1, 4)
    key = (which * 1024).astype(np.int32)[:, None] + px
    if len(px) and (px[:, 0] == px[0, 0]).all():  # as where all is opaque
        key = key[:, 1:] + _FIRST[1:].astype(np.int32)
        out = np.bincount(key.ravel(), minlength=images * 1024).reshape(images, 1024)
        out[:, px[0, 0]] = np.bincount(which, minlength=images)
        return out
    return np.bincount((key + _FIRST).ravel(), minlength=images * 1024).reshape(images, 1024)


def _plans(images: list[np.ndarray], caches: tuple, copies: bool) -> list:
    """For each image (rows, columns, channels) a function that puts it to a Writer, under the size of colour cache of caches that costs least."""
    m, wide = len(images), np.array([x.shape[1] for x in images])
    each = np.concatenate([x.reshape(-1, 4) for x in images]).astype(np.int64)
    argb = (each[:, 0] << 24 | each[:, 1] << 16 | each[:, 2] << 8 | each[:, 3]).astype(np.uint32)
    count = np.array([x.shape[0] * x.shape[1] for x in images])
    end, image, n = np.cumsum(count), np.repeat(np.arange(m), count), len(argb)
    start, length, back = _copies(argb, image, end) if copies else (np.zeros(0, np.int64),) * 3
    inside = np.zeros(n + 1, np.int64)
    inside[start] += 1
    np.add.at(inside, start + length, -1)
    is_copy = np.zeros(n, bool)
    is_copy[start] = True
    tokens = np.flatnonzero((np.cumsum(inside[:n]) == 0) | is_copy)
    copy, own, colour = is_copy[tokens], image[tokens], each[tokens]
    sizes, extra_l, n_l = _prefixes(length)
    code = np.zeros(len(back), np.int64)
    for x in np.unique(wide[image[start]]):
        of = wide[image[start]] == x
        code[of] = _distance_codes(int(x), back[of])
    dist, extra_d, n_d = _prefixes(code)
    options = []
    for bits in caches:
        slot, hit = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        if bits:
            slot = (argb * np.uint32(CACHE_FACTOR) >> np.uint32(32 - bits)) | image.astype(np.uint32) << np.uint32(16)
            before = _latest(slot)
            hit = ((before >= 0) & (argb[before] == argb))[tokens] & ~copy
            slot = (slot[tokens] & np.uint32(0xFFFF)).astype(np.int64)
        real = ~copy & ~hit
        by_channel = _channel_counts(own[real], colour[real], m).reshape(m, 4, 256)
        cached = _counts(own[hit], slot[hit], m, 1 << bits) if bits else np.zeros((m, 0), np.int64)
        counts = np.concatenate([by_channel[:, 2], _counts(image[start], sizes, m, 24), cached, by_channel[:, 1], by_channel[:, 3], by_channel[:, 0], _counts(image[start], dist, m, 40)], 1)
        first = np.cumsum([0, 280 + cached.shape[1], 256, 256, 256])
        options.append((_bits_of(counts, first), bits, slot, hit, counts, first))
    best = np.argmin([x[0] for x in options], 0)
    slot, hit = (np.choose(best[own], [x[k] for x in options]) for k in (2, 3))
    alphabet = np.tile([280, 256, 256, 256, 40], (m, 1))
    alphabet[:, 0] += [1 << caches[b] if caches[b] else 0 for b in best]
    every = np.zeros((m, 5, int(alphabet.max())), np.int64)
    for b in np.unique(best):
        for j, x in enumerate(np.split(options[b][4], options[b][5][1:], 1)):
            every[best == b, j, : x.shape[1]] = x[best == b]
    alphabet, every = alphabet.ravel(), every.reshape(5 * m, -1)
    lengths = code_lengths(every, 15)
    heads, head_sizes, count_ = _length_fields(lengths, alphabet)
    head_cut = np.r_[0, np.cumsum(count_)][::5]
    codes = np.where(np.count_nonzero(lengths, 1)[:, None] > 1, canonical(lengths) | lengths << 32, 0)  # a code and, from bit 32, its length
    alphabet = codes.shape[1]
    codes, own_codes = codes.ravel(), own * (5 * alphabet)
    fields = np.zeros((len(tokens), 4), np.int64)
    green = colour[:, 2].copy()
    green[copy] = 256 + sizes
    green[hit] = 280 + slot[hit]
    fields[:, 0] = codes.take(own_codes + green)
    real = ~copy & ~hit
    for j, channel in ((1, 1), (2, 3), (3, 0)):
        fields[:, j] = np.where(real, codes.take(own_codes + (j * alphabet + colour[:, channel])), 0)
    fields[copy, 1] = extra_l | n_l << 32
    fields[copy, 2] = codes.take(own_codes[copy] + 4 * alphabet + dist)
    fields[copy, 3] = extra_d | n_d << 32
    there = fields >> 32 > 0
    fields, cut = fields[there], np.r_[0, np.cumsum(there.sum(1))][np.searchsorted(own, np.arange(m + 1))]
    values, sizes_ = fields & 0xFFFFFFFF, fields >> 32

    def putter(k):
        def put(w: Writer, top: bool):
            bits = caches[best[k]]
            w.put(1 if bits else 0, 1)
            if bits:
                w.put(bits, 4)
            if top:
                w.put(0, 1)  # one group of codes
            w.put_all(heads[head_cut[k] : head_cut[k + 1]], head_sizes[head_cut[k] : head_cut[k + 1]])
            w.put_all(values[cut[k] : cut[k + 1]], sizes_[cut[k] : cut[k + 1]])

        return put

    return [putter(k) for k in range(m)]


def _put_image(w: Writer, px: np.ndarray, top: bool, caches: tuple = (0,), copies: bool = True):
    _plans([px], caches, copies)[0](w, top)


def _file(data: bytes) -> bytes:
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad


def _neighbours(px: np.ndarray):
    """Left, top, top-left and top-right pixels of all but the first row and column."""
    return px[1:, :-1], px[:-1, 1:], px[:-1, :-1], np.concatenate([px[:-1, 2:], px[1:, :1]], 1)


def _residuals(px: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """px less the predictions by block."""
    out = px.copy()
    out[0, 1:] -= px[0, :-1]
    out[1:, 0] -= px[:-1, 0]
    out[0, 0, 0] -= 255
    high, wide, _ = px.shape
    if high > 1 and wide > 1:
        own = modes[np.arange(1, high)[:, None] >> bits, np.arange(1, wide)[None] >> bits]
        around = _neighbours(px)
        for m in np.unique(own):
            i = own == m
            out[1:, 1:][i] -= _guess(int(m), *(x[i] for x in around))
    return out & 255


def _blocks(x: np.ndarray, bits: int, cut: int = 0) -> np.ndarray:
    """Sums of x (rows, columns) over blocks of the image whose first `cut` rows and columns x lacks."""
    rows, columns = (np.maximum(np.arange(0, n + cut, 1 << bits) - cut, 0) for n in x.shape)
    if cut:  # a last block of nothing but what x lacks can't be: cut is less than a block
        rows, columns = rows[rows < x.shape[0]], columns[columns < x.shape[1]]
    return np.add.reduceat(np.add.reduceat(x, rows, 0), columns, 1)


def best_modes(px: np.ndarray, bits: int = BLOCK_BITS) -> np.ndarray:
    """The predictor of each block whose residuals are the least in all."""
    high, wide, _ = px.shape
    if high == 1 or wide == 1:
        return np.ones((-(-high >> bits), -(-wide >> bits)), np.int64)
    planes = np.ascontiguousarray(np.moveaxis(px, -1, 0), np.int16)
    here, around = planes[:, 1:, 1:], (planes[:, 1:, :-1], planes[:, :-1, 1:], planes[:, :-1, :-1], np.concatenate([planes[:, :-1, 2:], planes[:, 1:, :1]], 2))
    costs = []
    for m in MODES:
        d = (here - _guess(m, *around, axis=0)).astype(np.int8)  # wraps as samples do
        costs.append(_blocks(np.abs(d.astype(np.int16)).sum(0, dtype=np.int32), bits, 1))
    return np.array(MODES)[np.argmin(costs, 0)]


def best_factors(px: np.ndarray, bits: int = BLOCK_BITS) -> np.ndarray:
    """Cross-colour elements of each block, by least squares."""
    signed = (px + 128 & 255) - 128
    r, g, b = (signed[..., k].astype(float) for k in (1, 2, 3))
    each = np.maximum(_blocks(g * g, bits), 1)
    fit = lambda y: np.clip(np.rint(32 * _blocks(g * y, bits) / each), -127, 127).astype(np.int64)
    out = np.zeros((*each.shape, 4), np.int64)
    out[..., 0], out[..., 3], out[..., 2] = 255, fit(r), fit(b)
    return out & 255


def _packed(px: np.ndarray):
    """The palette of px and its pixels as bundled indexes, if it has one."""
    argb = (px[..., 0] << 24 | px[..., 1] << 16 | px[..., 2] << 8 | px[..., 3]).ravel()
    colours, index = np.unique(argb, return_inverse=True)
    if len(colours) > 256:
        return None
    n, (high, wide) = _bundle(len(colours)), px.shape[:2]
    each = 1 << n
    index = np.pad(index.reshape(high, wide), ((0, 0), (0, -wide % each)))
    out = np.zeros((high, index.shape[1] // each, 4), np.int64)
    out[..., 0] = 255
    out[..., 2] = (index.reshape(high, -1, each) << np.arange(each) * (8 >> n)).sum(-1)
    return np.diff(_channels(colours, 1, len(colours)), axis=1, prepend=0) & 255, out


def _transformed(px: np.ndarray, kinds: tuple, side: dict, bits: int):
    """What kinds in turn leave of px, and what is to be written of each of them; None if one of them can't be."""
    notes = []
    for kind in kinds:
        if kind in (PREDICTOR, CROSS):
            data = side[kind](px, bits)
            if kind == PREDICTOR:
                modes = np.zeros((*data.shape, 4), np.int64)
                modes[..., 0], modes[..., 2] = 255, data
                px, data = _residuals(px, data, bits), modes
            else:
                px = _cross(px, data, bits, -1)
        elif kind == SUBTRACT:
            px, data = px.copy(), None
            px[..., [1, 3]] = (px[..., [1, 3]] - px[..., 2:3]) & 255
        else:
            got = _packed(px)
            if got is None:
                return None
            data, px = got
        notes.append((kind, data))
    return px, notes


def _all_written(parts: list, caches: tuple, copies: bool, bits: int) -> list[bytes]:
    """For each shape, pixels that transforms left and notes of these a file; the side images of all are planned together."""
    sides = [data for _, _, notes in parts for _, data in notes if data is not None]
    put = iter(_plans(sides, (0,), True) if sides else ())
    return [_written(plan, shape, [(kind, data, None if data is None else next(put)) for kind, data in notes], bits) for plan, (shape, _, notes) in zip(_plans([x[1] for x in parts], caches, copies), parts)]


def _written(plan, shape: tuple, notes: list, bits: int) -> bytes:
    """A file of what transforms noted left, which plan puts."""
    w = Writer()
    for v, n in ((0x2F, 8), (shape[1] - 1, 14), (shape[0] - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    for kind, data, side in notes:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS):
            w.put(bits - 2, 3)
        elif kind == PALETTE:
            w.put(data.shape[1] - 1, 8)
        if side:
            side(w, False)
    w.put(0, 1)
    plan(w, True)
    return _file(w.data())


BEST = {PREDICTOR: best_modes, CROSS: best_factors}


def encode(px: np.ndarray, transforms: tuple = (), caches: tuple = (0,), copies: bool = True, bits: int = 3, side: dict | None = None) -> bytes:
    """A lossless WebP file of px (rows, columns, alpha red green blue). transforms: kinds in the order applied; side: functions that choose the blocks' modes and elements."""
    got = _transformed(px.astype(np.int64), transforms, side or BEST, bits)
    if got is None:
        raise ValueError("too many colours for a palette")
    return _all_written([(px.shape, *got)], caches, copies, bits)[0]


KINDS = ((), (SUBTRACT,), (PREDICTOR,), (CROSS,), (PALETTE,))


def estimates(images: list[np.ndarray]) -> np.ndarray:
    """About the bits that each image takes under each of KINDS. The images are of one width and of ROWS rows at most, so that a block has all their rows."""
    m, tall = len(images), np.array([len(x) for x in images])
    px, first, image = np.concatenate(images).astype(np.int16), np.cumsum(tall) - tall, np.repeat(np.arange(len(images)), tall)
    rows, wide, _ = px.shape
    blocks, block, which = np.arange(0, wide, 1 << BLOCK_BITS), np.arange(wide) >> BLOCK_BITS, np.repeat(image, wide)

    def bits(left, *notes):
        cost = _bits_of(_channel_counts(which, left, m), _FIRST)
        for x in notes:
            cost = cost + _bits_of(_channel_counts(np.repeat(np.arange(m), x.shape[1]), x.reshape(-1, 4), m), _FIRST)
        return cost

    def per_block(x, columns):
        return np.add.reduceat(np.add.reduceat(x, columns, 1), first, 0)

    less_green = px.copy()
    less_green[..., [1, 3]] = (px[..., [1, 3]] - px[..., 2:3]) & 255

    planes = np.ascontiguousarray(np.moveaxis(px, -1, 0))
    here, around = planes[:, 1:, 1:], (planes[:, 1:, :-1], planes[:, :-1, 1:], planes[:, :-1, :-1], np.concatenate([planes[:, :-1, 2:], planes[:, 1:, :1]], 2))
    fresh = np.zeros(rows, bool)
    fresh[first] = True  # the first rows of images, which have nothing above them
    costs, residuals = [], []
    for mode in MODES:
        d = (here - _guess(mode, *around, axis=0)).astype(np.int8)  # wraps as samples do
        size = np.abs(d.astype(np.int16)).sum(0, dtype=np.int32)
        size[fresh[1:]] = 0
        costs.append(per_block(np.pad(size, ((1, 0), (0, 0))), np.maximum(blocks - 1, 0)))
        residuals.append(d)
    modes = np.argmin(costs, 0)
    left = px.copy()
    left[:, 1:] -= px[:, :-1]  # as for first rows
    below = ~fresh
    left[below, 0] = (px[1:, 0] - px[:-1, 0])[below[1:]]
    own = modes[image][:, block][1:, 1:]
    chosen = np.zeros(here.shape, np.int8)
    for k, d in enumerate(residuals):
        np.copyto(chosen, d, where=own == k)
    left[1:, 1:][below[1:]] = np.moveaxis(chosen, 0, -1)[below[1:]]
    note = np.zeros((*modes.shape, 4), np.int64)
    note[..., 0], note[..., 2] = 255, np.array(MODES)[modes]
    predicted = bits(left & 255, note)

    signed = (planes + 128 & 255) - 128
    r, g, b = (signed[k].astype(np.int32) for k in (1, 2, 3))
    each = np.maximum(per_block(g * g, blocks), 1)
    fit = lambda y: np.clip(np.rint(32 * per_block(g * y, blocks) / each), -127, 127).astype(np.int32)
    to_red, to_blue = fit(r), fit(b)
    crossed = px.copy()
    crossed[..., 1] = px[..., 1] - (to_red[image][:, block] * g >> 5) & 255
    crossed[..., 3] = px[..., 3] - (to_blue[image][:, block] * g >> 5) & 255
    note = np.stack([np.full(to_red.shape, 255), 0 * to_red, to_blue & 255, to_red & 255], -1).astype(np.int64)

    argb = planes[0].astype(np.int64) << 24 | planes[1].astype(np.int64) << 16 | planes[2].astype(np.int64) << 8 | planes[3]
    colours, often = np.unique((argb | image[:, None] << 32).ravel(), return_counts=True)
    of = (colours >> 32).astype(int)
    many, total = np.bincount(of, minlength=m), tall * wide
    indexes = total * np.log2(total) - np.bincount(of, often * np.log2(often), minlength=m)
    packed = np.where(many <= 256, indexes + 16.0 * many, np.inf)  # about 12 bits for a colour, and its index's code
    return np.stack([bits(px), bits(less_green), predicted, bits(crossed, note), packed], 1)


def smallest_all(images: list[np.ndarray]) -> list[bytes]:
    """The smallest file of each image (rows, columns, alpha red green blue) among the transforms that seem near the best."""
    guess = estimates(images)
    near = guess <= NEARLY * guess.min(1, keepdims=True)
    out: list = [None] * len(images)
    todo = []
    for i, x in enumerate(images):
        for k in np.flatnonzero(near[i]):
            got = _transformed(x.astype(np.int64), KINDS[k], BEST, BLOCK_BITS)
            if got is not None:
                todo.append((i, x.shape, *got))
    for (i, *_), file in zip(todo, _all_written([x[1:] for x in todo], CACHES, True, BLOCK_BITS)):
        if out[i] is None or len(file) < len(out[i]):
            out[i] = file
    return out


# Bytes as images


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // WIDE)) * WIDE
    return raw + bytes([FILL]) * (size - len(raw)), len(raw)


def store_all(payloads: list[bytes]) -> list[bytes]:
    """For each payload (a multiple of WIDE bytes) the WebP files that hold it, one after the other."""
    images, owner, out = [], [], [[] for _ in payloads]

    def flush():
        for i, f in zip(owner, smallest_all(images) if images else ()):
            out[i].append(f)
        images.clear()
        owner.clear()

    for i, p in enumerate(payloads):
        rgb = np.frombuffer(p, np.uint8).reshape(-1, ACROSS, 3)
        for a in range(0, len(rgb), ROWS):
            images.append(np.concatenate([np.full((*rgb[a : a + ROWS].shape[:2], 1), 255, np.uint8), rgb[a : a + ROWS]], 2))
            owner.append(i)
            if len(images) >= WRITTEN:
                flush()
    flush()
    return [b"".join(x) for x in out]


def files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def load(media: list[bytes]) -> list[np.ndarray]:
    """The pixels (rows, columns, red green blue) that media (results of store_all) hold."""
    own = [files(m) for m in media]
    every = [f for x in own for f in x]
    got = iter(px[..., 1:] for i in range(0, len(every), AT_ONCE) for px in decode_all(every[i : i + AT_ONCE]))
    return [np.concatenate([next(got) for _ in x]) for x in own]


def feature(payload: bytes) -> str:
    """Rows, mean sample, and the share (in thousandths) of samples in each eighth of the range."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"{len(x) // WIDE};{x.mean(dtype=np.float64):.4f};" + ",".join(map(str, share))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Bytes of payload that a worker holds before it decodes them.
TOGETHER = 8 << 20


def keep_texts(docs: DataFrame, media: bool = False) -> DataFrame:
    """The columns of SCHEMA for each row of docs (doc_id, text), from the pixels read back; media adds the stored files and the pixel array: high, wide and samples (row by row, red, green and blue of each pixel)."""
    more = ", media binary, high int, wide int, samples binary" * media
    names = [x.split()[0] for x in (SCHEMA + more).split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def flush(ids, sizes, stored):
        rows = []
        for i, n, px, m in zip(ids, sizes, load(stored), stored):
            p = px.tobytes()
            rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p), m, *px.shape[:2], p)[: len(names)])
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)][: len(names)], names=names)

    def run(batches):
        ids, sizes, payloads, held = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                payload, n = payload_of(text.as_py())
                ids.append(i)
                sizes.append(n)
                payloads.append(payload)
                held += len(payload)
                if held >= TOGETHER:
                    yield flush(ids, sizes, store_all(payloads))
                    ids, sizes, payloads, held = [], [], [], 0
        if ids:
            yield flush(ids, sizes, store_all(payloads))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + more)


def op8(spark, sf_dir) -> DataFrame:
    return keep_texts(table(spark, sf_dir, "documents"))
