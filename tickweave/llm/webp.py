"""Lossless WebP as a store of bytes and a decoder for media columns.

The decoder reads any lossless stream: prefix codes, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. The store writes a payload as grey images of
192 samples a row (a payload of more than 16,384 rows becomes several images one after the other): subtract-green, literals and
back-references, one prefix code for samples and lengths and one for distances. Where an image's values call for it, it is
also written with a palette, the predictor or a colour cache, and the shortest form is kept. Cross-colour cannot make
a grey image shorter (see ``encode_grey``) and is inverted for media columns only.

Streams of the first form, nearly all of texts, are decoded many together, the others one by one by ``decode``.
Prefix-coded data has no random access, so many images are decoded together: their bits are cut in
chunks, all chunks decode at once from their nominal starts, and each then takes over from where the
one before really ended. Prefix codes fall into step after a few symbols, so this settles in a few
rounds; it goes on until every chunk starts where its predecessor ended, so the result is exact. Then
copies are resolved by following pointers, for all images at once.

Cases: a null text counts as empty, an empty text is 192 blanks; repeated rows each come out; an empty
table gives no rows; other columns are ignored; a broken stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW, MAX_ROWS, MAX_BITS = 192, 16384, 11
#: Bytes by which repeats are found, and least and most that one copy takes; distances are below the format's own bound.
MATCH, LEAST, MAX_LENGTH, MAX_DISTANCE = 8, 8, 4096, (1 << 20) - 128
#: Bits of a predictor block's side, bits of the colour caches tried, samples from which transforms are tried, and share of the bits below which one is written.
BLOCK, CACHES, TRIED, GAIN = 4, (4, 1, 6), 2 * ROW, 0.95
#: Payload bytes that are decoded together, and bits of a chunk.
TOGETHER, CHUNK = 3_000_000, 1024
#: Fixed values of the format: order of code-length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (columns back, rows up) of the short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)


class Bits:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        if self.at + n > len(self.data) * 8:
            raise ValueError("stream ends early")
        first = self.at >> 3
        x = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        return x & ((1 << n) - 1)


#: Numbers of 15 bits, the most a code has, with their bits turned round.
REVERSED = sum((np.arange(1 << 15) >> k & 1) << (14 - k) for k in range(15))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, already in the order its bits are read."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used):
        used = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[used]
        room = 1 << (15 - n)  # what each code takes of 15 bits
        codes[used] = REVERSED[(np.cumsum(room) - room) & 0x7FFF]
    return codes


class Code:
    """Prefix code as a table over the next bits: symbol and length."""

    def __init__(self, lengths: np.ndarray) -> None:
        used, self.lists = np.flatnonzero(lengths), None
        if len(used) == 1:
            self.bits, self.table = 0, np.array([used[0]], np.int32)
            self.size = np.zeros(1, np.int32)
            return
        n = lengths[used]
        self.bits = int(n.max(initial=0))
        if not len(used) or int((1 << (self.bits - n)).sum()) != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        by = np.argsort(n, kind="stable")
        each, turned = 1 << (self.bits - n[by]), REVERSED[: 1 << 15 : 1 << (15 - self.bits)]
        self.table, self.size = np.repeat(used[by], each)[turned].astype(np.int32), np.repeat(n[by], each)[turned].astype(np.int32)

    def read(self, b: Bits) -> int:
        if not self.bits:
            return int(self.table[0])
        if self.lists is None:
            self.lists = self.table.tolist(), self.size.tolist()
        first = b.at >> 3
        k = int.from_bytes(b.data[first : first + 4], "little") >> (b.at & 7) & ((1 << self.bits) - 1)
        b.at += self.lists[1][k]
        if b.at > len(b.data) * 8:
            raise ValueError("stream ends early")
        return self.lists[0][k]


@lru_cache(512)
def _lone(symbol: int) -> Code:
    lengths = np.zeros(symbol + 1, np.int64)
    lengths[symbol] = 1
    return Code(lengths)


def read_code(b: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        symbols = [first, b.read(8)] if two else [first]
        for s in symbols:
            if s >= alphabet:
                raise ValueError("symbol outside the alphabet")
            lengths[s] = 1
        return Code(lengths) if two else _lone(first)
    meta, n = np.zeros(19, np.int64), 4 + b.read(4)
    packed = b.read(3 * n)
    meta[list(LENGTH_ORDER[:n])] = [packed >> 3 * k & 7 for k in range(n)]
    code = Code(meta)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else alphabet
    # A length takes 14 bits at most, so four bytes hold it wherever it begins.
    data, at, mask, symbols, sizes = b.data, b.at, (1 << code.bits) - 1, code.table.tolist(), code.size.tolist()
    found, last = [], 8
    while len(found) < alphabet and left:
        left -= 1
        ahead = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        x, n = symbols[ahead & mask], sizes[ahead & mask]
        at += n
        if x < 16:
            found.append(x)
            last = x or last
            continue
        least, bits, value = (3, 2, last) if x == 16 else (3, 3, 0) if x == 17 else (11, 7, 0)
        found += [value] * (least + (ahead >> n & ((1 << bits) - 1)))
        at += bits
    if at > len(data) * 8:
        raise ValueError("stream ends early")
    if len(found) > alphabet:
        raise ValueError("too many code lengths")
    b.at = at
    lengths[: len(found)] = found
    return Code(lengths)


def _value(b: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + b.read(extra) + 1


def _group(b: Bits, cache: int) -> list[Code]:
    return [read_code(b, n) for n in (280 + cache, 256, 256, 256, 40)]


def _head(b: Bits, width: int, height: int, top: bool) -> tuple[int, np.ndarray | None, int, list[list[Code]]]:
    """Colour-cache bits, group of each block (or none), block bits, groups."""
    cache_bits = b.read(4) if b.read(1) else 0
    blocks, bits, count = None, 0, 1
    if top and b.read(1):
        bits = b.read(3) + 2
        meta = _pixels(b, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
        blocks = (meta >> 8) & 0xFFFF
        count = int(blocks.max()) + 1
    return cache_bits, blocks, bits, [_group(b, 1 << cache_bits if cache_bits else 0) for _ in range(count)]


def _pixels(b: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image, one pixel after another."""
    cache_bits, blocks, bits, groups = _head(b, width, height, top)
    out, n, i = [0] * (width * height), width * height, 0
    cache = [0] * (1 << cache_bits)
    while i < n:
        g = groups[0 if blocks is None else int(blocks[i // width >> bits, i % width >> bits])]
        s = g[0].read(b)
        if s < 256:
            r, bl, a = g[1].read(b), g[2].read(b), g[3].read(b)
            out[i] = a << 24 | r << 16 | s << 8 | bl
            if cache_bits:
                cache[(0x1E35A7BD * out[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[i]
            i += 1
        elif s < 280:
            length, code = _value(b, s - 256), _value(b, g[4].read(b))
            dist = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if dist > i or i + length > n:
                raise ValueError("back-reference outside the image")
            for k in range(i, i + length):
                out[k] = out[k - dist]
                if cache_bits:
                    cache[(0x1E35A7BD * out[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
            i += length
        else:
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.int64).reshape(height, width)


def _split(x: np.ndarray) -> np.ndarray:
    return np.stack([x >> k & 255 for k in (24, 16, 8, 0)], axis=-1)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, t, tl, tr):
    avg = lambda x, y: [(p + q) >> 1 for p, q in zip(x, y, strict=True)]
    clip = lambda v: min(255, max(0, v))
    if mode == 11:
        away_left = sum(abs(q - r) for q, r in zip(t, tl, strict=True))
        away_top = sum(abs(q - r) for q, r in zip(left, tl, strict=True))
        return left if away_left < away_top else t
    if mode == 12:
        return [clip(p + q - r) for p, q, r in zip(left, t, tl, strict=True)]
    if mode == 13:
        return [clip(p + int((p - q) / 2)) for p, q in zip(avg(left, t), tl, strict=True)]
    plain = {0: (255, 0, 0, 0), 1: left, 2: t, 3: tr, 4: tl}
    if mode in plain:
        return plain[mode]
    if mode == 5:
        return avg(avg(left, tr), t)
    if mode == 10:
        return avg(avg(left, tl), avg(t, tr))
    pair = {6: (left, tl), 7: (left, t), 8: (tl, t), 9: (t, tr)}.get(mode)
    return avg(*pair) if pair else (255, 0, 0, 0)


def unpredict(x: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Adds each pixel's prediction from the pixels before it."""
    height, width = x.shape
    c = _split(x).tolist()
    for i in range(height):
        for j in range(width):
            if i == 0:
                p = (255, 0, 0, 0) if j == 0 else c[0][j - 1]
            elif j == 0:
                p = c[i - 1][0]
            else:
                above = c[i - 1]
                p = _predict(int(modes[i >> bits, j >> bits]), c[i][j - 1], above[j], above[j - 1], above[j + 1] if j + 1 < width else c[i][0])
            c[i][j] = [(u + v) & 255 for u, v in zip(c[i][j], p, strict=True)]
    return _join(np.array(c))


def uncross(x: np.ndarray, blocks: np.ndarray, bits: int) -> np.ndarray:
    """Adds to red and blue their shares of green and red."""
    i, j = np.indices(x.shape)
    e = _split(blocks[i >> bits, j >> bits])
    signed = lambda v: ((v + 128) & 255) - 128
    share = lambda t, v: (signed(t) * signed(v)) >> 5
    c = _split(x)
    red = (c[..., 1] + share(e[..., 3], c[..., 2])) & 255
    blue = (c[..., 3] + share(e[..., 2], c[..., 2]) + share(e[..., 1], red)) & 255
    return _join(np.stack([c[..., 0], red, c[..., 2], blue], axis=-1))


def ungreen(x: np.ndarray) -> np.ndarray:
    c = _split(x)
    return _join(np.stack([c[..., 0], c[..., 1] + c[..., 2], c[..., 2], c[..., 3] + c[..., 2]], axis=-1))


def unpalette(x: np.ndarray, palette: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Colours of the indices; ``1 << bits`` indices share a pixel's green."""
    each = 8 >> bits
    g = x >> 8 & 255
    parts = np.stack([g >> (k * each) & ((1 << each) - 1) for k in range(1 << bits)], axis=-1).reshape(len(x), -1)[:, :width]
    return np.where(parts < len(palette), palette[np.minimum(parts, len(palette) - 1)], 0)


def open_stream(data: bytes) -> tuple[Bits, int, int]:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    b = Bits(data[20 : 20 + size])
    if b.read(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height = b.read(14) + 1, b.read(14) + 1
    if b.read(4) >> 1:
        raise ValueError("unknown version")
    return b, width, height


def decode(data: bytes) -> np.ndarray:
    """Pixel array (height, width, 4) of red, green, blue, alpha."""
    b, width, height = open_stream(data)
    steps, w = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (PREDICTOR, CROSS):
            bits = b.read(3) + 2
            steps.append((kind, _pixels(b, (w + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False), bits, w))
        elif kind == SUBTRACT:
            steps.append((kind, None, 0, w))
        else:
            n = b.read(8) + 1
            colours = _join(np.cumsum(_split(_pixels(b, n, 1, False)[0]), axis=0))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, colours, bits, w))
            w = (w + (1 << bits) - 1) >> bits
    x = _pixels(b, w, height, True)
    for kind, extra, bits, before in reversed(steps):
        x = unpredict(x, extra >> 8 & 15, bits) if kind == PREDICTOR else uncross(x, extra, bits) if kind == CROSS else ungreen(x) if kind == SUBTRACT else unpalette(x, extra, bits, before)
    return np.stack([x >> k & 255 for k in (16, 8, 0, 24)], axis=-1).astype(np.uint8)


def huffman(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths up to ``limit``; rare symbols are lifted until the code fits."""
    used = np.flatnonzero(counts)
    lengths, floor, n = np.zeros(len(counts), np.int64), 0, len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    while True:
        weight = np.maximum(counts[used], floor)
        by = np.argsort(weight, kind="stable")
        # Leaves by weight and the sums of pairs, which come in order too: the least two are at the front of either.
        leaf, inner, parent, i, j = [*weight[by].tolist(), 1 << 62], [], [0] * (2 * n - 1), 0, 0
        for k in range(n - 1):
            total = 0
            for _ in range(2):
                if j < k and inner[j] < leaf[i]:
                    total += inner[j]
                    parent[n + j] = n + k
                    j += 1
                else:
                    total += leaf[i]
                    parent[i] = n + k
                    i += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        lengths[used[by]] = depth[:n]
        if lengths.max() <= limit:
            return lengths
        floor = max(1, floor * 2, int(counts.sum()) >> (limit + 2))


class Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.n
        self.n += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Writes many values of 32 bits at most, one after another, by words of 64 bits."""
        if not len(values):
            return
        ends = np.cumsum(sizes)
        at = ends - sizes
        word, shift, v = at >> 6, (at & 63).astype(np.uint64), values.astype(np.uint64)
        # A value begins in every word up to the last begun; bits of values do not meet, so their sum holds them all.
        edges = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(v)]))
        words, last = np.zeros(int(word[-1]) + 2, np.uint64), edges[1:] - 1
        words[:-1] = np.add.reduceat(v << shift, edges[:-1])
        words[1:] |= v[last] >> np.uint64(1) >> (np.uint64(63) - shift[last])
        self.put(int.from_bytes(words.tobytes(), "little"), int(ends[-1]))

    def packed(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")

    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.packed(), np.uint8), bitorder="little")[: self.n]


def put_code(w: Writer, lengths: np.ndarray) -> None:
    """Writes a prefix code: simply for one symbol, else its lengths with runs of zeros."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(s > 1), 1)
        w.put(s, 8 if s > 1 else 1)
        return
    tokens = []
    new = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    for v, n in zip(lengths[new[:-1]].tolist(), [z - a for a, z in zip(new[:-1], new[1:], strict=True)], strict=True):
        while not v and n >= 3:
            tokens.append((17, min(n, 10) - 3, 3) if n < 11 else (18, min(n, 138) - 11, 7))
            n -= min(n, 138)
        tokens += [(v, 0, 0)] * n
    meta = huffman(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = canonical(meta)
    ordered = [meta.item(k) for k in LENGTH_ORDER]
    count = max(4, max(k for k in range(19) if ordered[k]) + 1)
    w.put(0, 1)
    w.put(count - 4, 4)
    w.put(sum(x << 3 * k for k, x in enumerate(ordered[:count])), 3 * count)
    w.put(0, 1)
    lone, value, at = np.count_nonzero(meta) == 1, 0, 0
    code, size = codes.tolist(), [0] * 19 if lone else meta.tolist()
    for s, extra, bits in tokens:
        value |= (code[s] | extra << size[s]) << at
        at += size[s] + bits
    w.put(value, at)


def _file(body: bytes) -> bytes:
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad


def copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of disjoint repeats, in order: runs of places whose MATCH bytes last stood at one distance."""
    none = np.zeros(0, np.int64)
    if len(x) < 2 * MATCH:
        return none, none, none
    grams = np.lib.stride_tricks.sliding_window_view(x, MATCH).copy().view(f"<u{MATCH}")[:, 0]
    low = np.uint64((1 << len(grams).bit_length()) - 1)
    keys = np.sort(grams * np.uint64(0x9E3779B97F4A7C15) & ~low | np.arange(len(grams), dtype=np.uint64))
    order = (keys & low).astype(np.int64)
    near = np.flatnonzero((keys[1:] ^ keys[:-1]) <= low)
    near = near[grams[order[near + 1]] == grams[order[near]]]  # equal hashes of unequal bytes are no repeat
    before = np.full(len(grams), -1, np.int64)
    before[order[near + 1]] = order[near]
    at = np.flatnonzero(before >= 0)
    far = at - before[at]
    at, far = at[far < MAX_DISTANCE], far[far < MAX_DISTANCE]
    if not len(at):
        return none, none, none
    edges = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1] + 1) | (far[1:] != far[:-1])) + 1, [len(at)]))
    new = edges[:-1]
    start, stop, far = at[new], at[edges[1:] - 1] + MATCH, far[new]
    start[1:] = np.maximum(start[1:], np.maximum.accumulate(stop)[:-1])  # one begins where the one before ends
    good = stop - start >= LEAST
    start, stop, far = start[good], stop[good], far[good]
    parts = -(-(stop - start) // MAX_LENGTH)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + (np.arange(parts.sum()) - first) * MAX_LENGTH
    return begin, np.minimum(begin + MAX_LENGTH, np.repeat(stop, parts)) - begin, np.repeat(far, parts)


def prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and its bits of lengths or distance codes, all at least 1."""
    n = v - 1
    high = np.frexp(np.maximum(n, 1).astype(float))[1].astype(np.int64) - 1
    extra = np.where(n < 4, 0, high - 1)
    return np.where(n < 4, n, 2 * high + (n >> np.maximum(high - 1, 0) & 1)), n & ((1 << extra) - 1), extra


def _bits_for(x: np.ndarray) -> float:
    """Bits that an ideal code of single values takes."""
    c = np.bincount(x)
    c = c[c > 0]
    return float(len(x) * np.log2(max(len(x), 1)) - (c * np.log2(c)).sum())


def _small(w: Writer, pixels: list[int]) -> None:
    """A little image (predictor modes, palette) of literals."""
    w.put(0, 1)
    channels = [np.array([x >> k & 255 for x in pixels]) for k in (8, 16, 0, 24)]
    codes = []
    for c, n in zip(channels, (280, 256, 256, 256), strict=True):
        lengths = huffman(np.bincount(c, minlength=n), MAX_BITS)
        put_code(w, lengths)
        codes.append((canonical(lengths), lengths if np.count_nonzero(lengths) > 1 else lengths * 0))
    w.put(1, 4)
    for pixel in zip(*channels, strict=True):
        for v, (code, size) in zip(pixel, codes, strict=True):
            w.put(int(code[v]), int(size[v]))


def slots_of(x: np.ndarray, bits: int) -> np.ndarray:
    """Place of each sample (green alone, opaque) in a colour cache."""
    return (0x1E35A7BD * (0xFF000000 | x.astype(np.int64) << 8) & 0xFFFFFFFF) >> (32 - bits)


def cached(x: np.ndarray, bits: int) -> np.ndarray:
    """Symbol of each sample: its place in the cache where that holds it, else the sample."""
    slots = slots_of(np.arange(256), bits)[x].astype(np.uint8)
    order = np.argsort(slots, kind="stable")
    held = np.zeros(len(x), bool)
    held[order[1:]] = (slots[order[1:]] == slots[order[:-1]]) & (x[order[1:]] == x[order[:-1]])
    return np.where(held, 280 + slots.astype(np.int64), x)


def predictions(x: np.ndarray) -> np.ndarray:
    """What each of the 14 modes predicts for the samples of a grey image, first row and column aside."""
    left, t, tl = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    tr = np.concatenate([x[:-1, 2:], x[1:, :1]], axis=1)
    avg = lambda p, q: (p + q) >> 1
    middle = avg(left, t)
    plain = [np.zeros_like(t), left, t, tr, tl, avg(avg(left, tr), t), avg(left, tl), middle, avg(tl, t), avg(t, tr), avg(avg(left, tl), avg(t, tr))]
    half = (middle - tl) - ((middle - tl) >> 15)  # halves are cut towards zero
    return np.stack([*plain, np.where(abs(t - tl) < abs(left - tl), left, t), np.clip(left + t - tl, 0, 255), np.clip(middle + (half >> 1), 0, 255)])


def predicted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mode of each block of BLOCK bits, residuals) of a grey image: of each block the mode of least residuals."""
    x = x.astype(np.int16)
    height, width = x.shape
    every = predictions(x)
    off = (x[1:, 1:] - every) & 255
    far = np.pad(np.minimum(off, 256 - off), ((0, 0), (1, -height % (1 << BLOCK)), (1, -width % (1 << BLOCK)))).astype(np.int64)
    sums = far.reshape(14, far.shape[1] >> BLOCK, 1 << BLOCK, far.shape[2] >> BLOCK, 1 << BLOCK).sum(axis=(2, 4))
    modes = sums.argmin(axis=0)
    i, j = np.indices((height - 1, width - 1)) + 1
    out = x.copy()
    out[0, 1:] -= x[0, :-1]
    out[1:, 0] -= x[:-1, 0]
    out[1:, 1:] = np.take_along_axis(off, modes[i >> BLOCK, j >> BLOCK][None], axis=0)[0]
    return modes, (out & 255).astype(np.uint8)


def _image(height: int, put_steps, x: np.ndarray, alpha: int, cache: int = 0) -> bytes:
    """A file: head, transforms, and the green samples ``x`` as literals, cached colours and back-references."""
    w = Writer()
    for v, n in ((0x2F, 8), (ROW - 1, 14), (height - 1, 14), (0, 4)):
        w.put(v, n)
    put_steps(w)
    w.put(0, 1)
    w.put(cache << 1 | 1 if cache else 0, 5 if cache else 1)
    w.put(0, 1)
    start, length, far = copies(x)
    literal = np.ones(len(x), bool)
    if len(start):
        edge = np.zeros(len(x) + 1, np.int8)
        edge[start] = 1
        edge[start + length] -= 1
        literal = np.cumsum(edge[:-1], dtype=np.int8) == 0
    (ls, lx, ln), (ds, dx, dn) = prefixed(length), prefixed(far + len(NEAR))
    plain = (cached(x, cache) if cache else x)[literal]
    size_of = 280 + (1 << cache if cache else 0)
    counts = np.bincount(plain, minlength=size_of) + np.bincount(256 + ls, minlength=size_of)
    lengths, distances = huffman(counts, MAX_BITS), huffman(np.bincount(ds, minlength=40), MAX_BITS)
    put_code(w, lengths)
    for v, n in ((1, 4), (1, 4), (5 | alpha << 3, 11)):  # simple codes of one symbol each: 0, 0 and alpha
        w.put(v, n)
    if len(ds):
        put_code(w, distances)
    else:
        w.put(1, 4)
    codes, far_codes = canonical(lengths).astype(np.uint32), canonical(distances).astype(np.uint32)
    size = lengths if np.count_nonzero(lengths) > 1 else lengths * 0
    far_size = distances if np.count_nonzero(distances) > 1 else distances * 0
    items, bits = codes[plain], size[plain]
    if len(start):
        # Four items to a copy (length, its extra bits, distance, its extra bits) stand behind the literals before it.
        behind = start - (np.cumsum(length) - length) + 4 * np.arange(len(start))
        is_plain = np.ones(len(plain) + 4 * len(start), bool)
        places = np.stack([behind, behind + 1, behind + 2, behind + 3])
        is_plain[places] = False
        merged, widths = np.empty(len(is_plain), np.int64), np.empty(len(is_plain), np.int64)
        merged[is_plain], widths[is_plain] = items, bits
        merged[places], widths[places] = [codes[256 + ls], lx, far_codes[ds], dx], [size[256 + ls], ln, far_size[ds], dn]
        items, bits = merged, widths
    for k in range(0, len(items), 500_000):
        w.put_all(items[k : k + 500_000], bits[k : k + 500_000])
    return _file(w.packed())


def _green_step(w: Writer) -> None:
    w.put(1 | SUBTRACT << 1, 3)


def _with_palette(samples: np.ndarray, height: int, values: np.ndarray) -> bytes:
    """The image as places in a palette of 16 greys at most, two to eight of them to a pixel."""
    bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    place = np.zeros(256, np.uint8)
    place[values] = np.arange(len(values))
    parts = place[samples].reshape(height, ROW >> bits, 1 << bits)
    packed = np.bitwise_or.reduce(parts << (np.arange(1 << bits) * (8 >> bits)).astype(np.uint8), axis=2).reshape(-1)
    steps = np.diff(values, prepend=0).tolist()

    def put(w: Writer) -> None:
        w.put(1 | PALETTE << 1 | (len(values) - 1) << 3, 11)
        _small(w, [(0 if k else 255 << 24) | v << 16 | v << 8 | v for k, v in enumerate(steps)])

    return _image(height, put, packed, 0)


def _with_predictor(samples: np.ndarray, height: int) -> bytes:
    """The image as residuals of the modes that come nearest, block by block."""
    modes, residuals = predicted(samples.reshape(height, ROW))

    def put(w: Writer) -> None:
        _green_step(w)
        w.put(1 | PREDICTOR << 1 | (BLOCK - 2) << 3, 6)
        _small(w, [m << 8 for m in modes.reshape(-1).tolist()])

    return _image(height, put, residuals.reshape(-1), 0)


def encode_grey(samples: np.ndarray) -> bytes:
    """One grey image of 192 samples a row: the shortest of those that a look at its values calls for.

    Subtract-green, literals and back-references always; besides, a palette where there are 16 values at most, the predictor where
    differences to the left or to the row above take fewer bits than values, a colour cache where its places do. Cross-colour
    has nothing to do in a grey image: red and blue are zero after subtract-green and cost no bit.
    """
    height = len(samples) // ROW
    forms = [_image(height, _green_step, samples, 255)]
    if len(samples) >= TRIED:
        now, wide = _bits_for(samples), samples.reshape(height, ROW)
        values = np.flatnonzero(np.bincount(samples))
        if len(values) <= 16:
            forms.append(_with_palette(samples, height, values))
        if any(_bits_for(x) < GAIN * now for x in (samples[1:] - samples[:-1], (wide[1:] - wide[:-1]).reshape(-1)) if len(x)):
            forms.append(_with_predictor(samples, height))
        if _bits_for(cached(samples, CACHES[0])) < GAIN * now:
            forms += [_image(height, _green_step, samples, 255, bits) for bits in CACHES]
    return min(forms, key=len)


def store(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a multiple of 192."""
    x = np.frombuffer(payload, np.uint8)
    return b"".join(encode_grey(x[k : k + ROW * MAX_ROWS]) for k in range(0, len(x), ROW * MAX_ROWS))


def images_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out


def _green_only(image: bytes) -> tuple[bytes, int, Code, Code, int] | None:
    """(stream, first bit, codes of samples and distances, samples) of a grey image as stored here; none for any other stream."""
    b, width, height = open_stream(image)
    if width != ROW or not b.read(1) or b.read(2) != SUBTRACT or b.read(1) or b.read(1) or b.read(1):
        return None
    g = _group(b, 0)
    if any(c.bits for c in g[1:4]) or int(g[1].table[0]) or int(g[2].table[0]) or not g[0].bits and int(g[0].table[0]) > 255:
        return None
    return b.data, b.at, g[0], g[4], width * height


def _joined(codes: list[Code], shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes' tables one after another (length above ``shift`` bits of symbol), where each begins, and their masks."""
    tables = [(c.size << shift | c.table).astype(np.uint16) for c in codes]
    return np.concatenate(tables), np.cumsum([0] + [len(t) for t in tables])[:-1], np.array([(1 << c.bits) - 1 for c in codes], np.uint32)


def _unprefixed(symbol: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of prefix symbols whose extra bits come next in ``ahead``, and how many these are."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + (ahead & ((1 << extra) - 1)) + 1), extra


def _lanes(streams: list[tuple[bytes, int, Code, Code, int]]) -> list[np.ndarray]:
    """Green samples of many images, all chunks of all images at once."""
    buf = np.frombuffer(b"".join(s[0] + b"\0" * 16 for s in streams) + b"\0" * 16, np.uint8).astype(np.uint32)
    window = buf[:-3] | buf[1:-2] << 8 | buf[2:-1] << 16 | buf[3:] << 24
    at = np.cumsum([0] + [len(s[0]) + 16 for s in streams])
    table, base, masks = _joined([s[2] for s in streams], 9)
    far_table, far_base, far_masks = _joined([s[3] for s in streams], 6)
    near = np.array([max(1, x + y * ROW) for x, y in NEAR], np.int64)
    begin, stop, owner = [], [], []
    for k, (data, first, *_) in enumerate(streams):
        starts = np.arange(first, len(data) * 8, CHUNK) if first < len(data) * 8 else np.array([first])
        begin.append(starts + at[k] * 8)
        stop.append(np.r_[starts[1:], len(data) * 8] + at[k] * 8)
        owner.append(np.full(len(starts), k))
    begin, stop, owner = np.concatenate(begin), np.concatenate(stop), np.concatenate(owner)
    head = np.r_[True, owner[1:] != owner[:-1]]
    least = max(1, min(int(s[2].size.min()) for s in streams))
    got, gone = np.zeros((len(begin), CHUNK // least + 2), np.uint16), np.zeros((len(begin), CHUNK // least + 2), np.int32)
    count, end, todo = np.zeros(len(begin), np.int64), begin.copy(), np.arange(len(begin))
    while todo.size:
        lane, pos, step = todo, begin[todo].copy(), 0
        count[todo], end[todo] = 0, begin[todo]
        live = pos < stop[lane]
        lane, pos = lane[live], pos[live]
        lane_owner, top = owner[lane], stop[lane]
        m, sh = masks[lane_owner], base[lane_owner]
        while lane.size:
            ahead = window[pos >> 3] >> (pos & 7).astype(np.uint32)
            entry = table[sh + (ahead & m)]
            token = entry & 511
            pos = pos + (entry >> 9)
            c = np.flatnonzero(token > 255)
            if c.size:
                long, extra = _unprefixed(token[c].astype(np.int64) - 256, (ahead[c] >> (entry[c] >> 9)).astype(np.int64))
                p, o = pos[c] + extra, lane_owner[c]
                ahead = (window[p >> 3].astype(np.int64) | window[(p >> 3) + 4].astype(np.int64) << 32) >> (p & 7)
                entry = far_table[far_base[o] + (ahead & far_masks[o])].astype(np.int64)
                code, extra = _unprefixed(entry & 63, ahead >> (entry >> 6))
                pos[c] = p + (entry >> 6) + extra
                token[c] = 255 + long
                gone[lane[c], step] = np.where(code > len(near), code - len(near), near[np.minimum(code, len(near)) - 1])
            got[lane, step] = token
            step += 1
            over = pos >= top
            if over.any():
                x = lane[over]
                end[x], count[x] = pos[over], step
                keep = ~over
                lane, pos, lane_owner, m, sh, top = lane[keep], pos[keep], lane_owner[keep], m[keep], sh[keep], top[keep]
        after = np.r_[begin[0], end[:-1]]
        todo = np.flatnonzero(~head & (after != begin))
        begin[todo] = after[todo]
    real = np.arange(got.shape[1])[None, :] < count[:, None]
    token, far = got[real].astype(np.int64), gone[real].astype(np.int64)
    ends = np.cumsum(count)[np.flatnonzero(np.r_[head[1:], True])]
    return _resolved(token, far, ends, [s[4] for s in streams])


def _resolved(token: np.ndarray, far: np.ndarray, ends: np.ndarray, samples: list[int]) -> list[np.ndarray]:
    """Samples of each stream from its tokens (a value, or 255 and a length with a distance), which end at ``ends``.

    A copied sample points at the one it repeats; pointers are followed for all streams at once, twice as far
    every round, until each points at a literal.
    """
    size = np.where(token > 255, token - 255, 1)
    stop = np.cumsum(size)
    start, out = stop - size, np.full(int(stop[-1]) if len(stop) else 0, 0, np.uint8)
    value = token < 256
    out[start[value]] = token[value]
    which = np.flatnonzero(~value)
    place = np.repeat(start[which], size[which]) + np.arange(size[which].sum()) - np.repeat(np.cumsum(size[which]) - size[which], size[which])
    source = np.arange(len(out), dtype=np.int32 if len(out) < 1 << 31 else np.int64)
    first = np.r_[0, ends[:-1]]
    begin = np.where(first < len(start), start[np.minimum(first, len(start) - 1)] if len(start) else 0, len(out))
    owner = np.searchsorted(ends, which, side="right")
    source[place] = place - np.repeat(far[which], size[which])
    inside = place < np.repeat((begin + np.array(samples))[owner], size[which])
    if (source[place] < np.repeat(begin[owner], size[which]))[inside].any():
        raise ValueError("copy from before the image")
    place = place[inside]
    todo = place
    while todo.size:
        now = source[todo]
        further = source[now]
        more = further != now
        todo = todo[more]
        source[todo] = further[more]
    out[place] = out[source[place]]
    parts = []
    for a, n, z in zip(begin.tolist(), samples, np.r_[begin[1:], len(out)].tolist(), strict=True):
        if z - a < n:
            raise ValueError("stream ends early")
        parts.append(out[a : a + n])
    return parts


def read_many(media: list[bytes]) -> list[np.ndarray]:
    """Samples of stored payloads, in order."""
    images = [(i, x) for i, m in enumerate(media) for x in images_of(m)]
    parts: list[list[np.ndarray | None]] = [[] for _ in media]
    fast, places = [], []
    for i, image in images:
        s = _green_only(image)
        if s is None:
            parts[i].append(decode(image)[..., 1].reshape(-1))
        elif not s[2].bits:
            parts[i].append(np.full(s[4], s[2].table[0], np.uint8))
        else:
            places.append((i, len(parts[i])))
            parts[i].append(None)
            fast.append(s)
    if fast:
        for (i, k), x in zip(places, _lanes(fast), strict=True):
            parts[i][k] = x
    return [np.concatenate(p) for p in parts]


def feature(x: np.ndarray) -> str:
    """Mean, spread and distinct samples, and the share of rising steps, of the samples read back."""
    rising = np.count_nonzero(x[1:] > x[:-1]) / (len(x) - 1) if len(x) > 1 else 0.0
    counts, value = np.bincount(x, minlength=256), np.arange(256)
    total, squares = int((counts * value).sum()), int((counts * value * value).sum())
    spread = math.sqrt(len(x) * squares - total * total) / len(x)
    return f"{total / len(x):.4f}|{spread:.4f}|{np.count_nonzero(counts)}|{rising:.4f}"


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW if text else ROW)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def flush(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        media = [store(payload_of(t)) for t in texts]
        rows = []
        for d, t, m, x in zip(ids, texts, media, read_many(media), strict=True):
            back = x.tobytes()
            rows.append((d, len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(x)))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        ids, texts, size = [], [], 0
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            ids.append(d)
            texts.append(t or b"")
            size += len(texts[-1])
            if size > TOGETHER:
                yield flush(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)


def query(docs: DataFrame) -> DataFrame:
    schema = "doc_id BIGINT, n_bytes BIGINT, payload_bytes BIGINT, payload_sha256 STRING, tail_crc32 BIGINT, media_bytes BIGINT, media_sha256 STRING, feature STRING"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_run, schema)


def decode_column(media: DataFrame, column: str = "media") -> DataFrame:
    """Rows with ``height``, ``width`` and the pixels (red, green, blue, alpha bytes) of a media column; nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = [None if x is None else decode(x) for x in b.column(column).to_pylist()]
            cols = [pa.array([None if x is None else x.shape[k] for x in images], pa.int32()) for k in (0, 1)]
            pixels = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, pixels], [*b.schema.names, "height", "width", "pixels"])

    kept = media.drop("height", "width", "pixels")
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "height INT, width INT, pixels BINARY"]))
