"""Round trips, and hand-made streams with every part of the format."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickweave.llm import webp


def stream(width, height, steps, main):
    """A file with the given transform writers and main image writer."""
    w = webp.Writer()
    for x, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 4)):
        w.put(x, n)
    for step in steps:
        w.put(1, 1)
        step(w)
    w.put(0, 1)
    main(w)
    return webp._file(np.packbits(w.bits(), bitorder="little").tobytes())


def put_pixels(w, tokens, top, cache_bits=0):
    """Tokens: ('p', argb), ('r', length symbol, extra, bits, distance symbol, extra, bits), ('c', index)."""
    w.put(int(bool(cache_bits)), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    counts = [np.zeros(n, np.int64) for n in (size, 256, 256, 256, 40)]
    for t in tokens:
        if t[0] == "p":
            a, r, g, b = (t[1] >> k & 255 for k in (24, 16, 8, 0))
            for c, s in zip(counts, (g, r, b, a), strict=False):
                c[s] += 1
        elif t[0] == "r":
            counts[0][256 + t[1]] += 1
            counts[4][t[4]] += 1
        else:
            counts[0][280 + t[1]] += 1
    lengths = []
    for c in counts:
        if not c.any():
            c[0] = 1
        n = webp.huffman(c, 15)
        webp.put_code(w, n)
        lengths.append((n, webp.canonical(n), np.count_nonzero(n) == 1))

    def sym(k, s):
        n, codes, lone = lengths[k]
        if not lone:
            w.put(int(codes[s]), int(n[s]))

    for t in tokens:
        if t[0] == "p":
            a, r, g, b = (t[1] >> k & 255 for k in (24, 16, 8, 0))
            for k, s in enumerate((g, r, b, a)):
                sym(k, s)
        elif t[0] == "r":
            sym(0, 256 + t[1])
            w.put(t[2], t[3])
            sym(4, t[4])
            w.put(t[5], t[6])
        else:
            sym(0, 280 + t[1])


def noise(n, seed):
    r = random.Random(seed)
    return [r.randrange(1 << 32) for _ in range(n)]


def argb(px):
    return [[int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in row] for row in px.tolist()]


def test_literals_and_subtract_green():
    px = noise(35, 1)
    assert sum(argb(webp.decode(stream(7, 5, [], lambda w: put_pixels(w, [("p", x) for x in px], True)))), []) == px
    minus = [x & 0xFF00FF00 | ((x >> 16) - (x >> 8) & 255) << 16 | ((x - (x >> 8)) & 255) for x in px]
    data = stream(7, 5, [lambda w: w.put(webp.SUBTRACT, 2)], lambda w: put_pixels(w, [("p", x) for x in minus], True))
    assert sum(argb(webp.decode(data)), []) == px


def test_back_references_and_cache():
    px = noise(6, 2)
    slot = lambda x: (0x1E35A7BD * x & 0xFFFFFFFF) >> 28
    # six literals; 3 pixels from one row up (code 1); 5 pixels from distance 2 (code 122 = symbol 13 with 5 extra bits); a cached pixel
    symbol, extra = 13, (122 - 1) - (3 << 5)
    tokens = [*[("p", x) for x in px], ("r", 2, 0, 0, 0, 0, 0), ("r", 4, 0, 1, symbol, extra, 5), ("c", slot(px[0]))]
    want = list(px)
    for _ in range(3):
        want.append(want[-5])
    for _ in range(5):
        want.append(want[-2])
    want.append({slot(x): x for x in want}[slot(px[0])])
    got = webp.decode(stream(5, 3, [], lambda w: put_pixels(w, tokens, True, 4)))
    assert sum(argb(got), []) == want


def test_palette():
    colours = [0xFF000000 | x & 0xFFFFFF for x in noise(13, 3)]
    r = random.Random(1)
    index = [[r.randrange(13) for _ in range(9)] for _ in range(4)]

    def table(w):
        w.put(webp.PALETTE, 2)
        w.put(12, 8)
        diff = [colours[0], *[sum(((b >> k & 255) - (a >> k & 255) & 255) << k for k in (0, 8, 16, 24)) for a, b in zip(colours, colours[1:], strict=False)]]
        put_pixels(w, [("p", x) for x in diff], False)

    packed = [("p", 0xFF000000 | sum(row[2 * k + j] << 4 * j for j in range(2) if 2 * k + j < 9) << 8) for row in index for k in range(5)]
    got = webp.decode(stream(9, 4, [table], lambda w: put_pixels(w, packed, True)))
    assert argb(got) == [[colours[i] for i in row] for row in index]


@pytest.mark.parametrize("mode", range(14))
def test_predictor_inverse(mode):
    width, height, px = 6, 5, noise(30, mode)
    split = [[[px[i * width + j] >> k & 255 for k in (24, 16, 8, 0)] for j in range(width)] for i in range(height)]
    res = []
    for i in range(height):
        for j in range(width):
            if i == 0:
                p = (255, 0, 0, 0) if j == 0 else split[0][j - 1]
            elif j == 0:
                p = split[i - 1][0]
            else:
                p = webp._predict(mode, split[i][j - 1], split[i - 1][j], split[i - 1][j - 1], split[i - 1][j + 1] if j + 1 < width else split[i][0])
            res.append(sum(((u - v) & 255) << k for u, v, k in zip(split[i][j], p, (24, 16, 8, 0), strict=True)))

    def step(w):
        w.put(webp.PREDICTOR, 2)
        w.put(1, 3)
        put_pixels(w, [("p", mode << 8)], False)

    assert sum(argb(webp.decode(stream(width, height, [step], lambda w: put_pixels(w, [("p", x) for x in res], True)))), []) == px


def test_cross_colour():
    px, e = noise(12, 5), (200, 7, 131)  # red to blue, green to blue, green to red
    s8 = lambda v: ((v + 128) & 255) - 128
    res = []
    for x in px:
        r, g, b = x >> 16 & 255, x >> 8 & 255, x & 255
        nb = b - (s8(e[1]) * s8(g) >> 5) - (s8(e[0]) * s8(r) >> 5) & 255
        res.append(x & 0xFF00FF00 | (r - (s8(e[2]) * s8(g) >> 5) & 255) << 16 | nb)

    def step(w):
        w.put(webp.CROSS, 2)
        w.put(0, 3)
        put_pixels(w, [("p", 0xFF000000 | e[0] << 16 | e[1] << 8 | e[2])], False)

    assert sum(argb(webp.decode(stream(4, 3, [step], lambda w: put_pixels(w, [("p", x) for x in res], True)))), []) == px


def test_store_round_trip(monkeypatch):
    r = np.random.default_rng(1)
    texts = [b"", b"a" * 500, b" ", bytes(r.integers(0, 256, 5000, dtype=np.uint8)), "häus und hof ".encode() * 900, bytes(r.choice([97, 98, 99], 3000, p=[0.98, 0.01, 0.01]).astype(np.uint8))]
    texts.append(b"".join(bytes([65 + k]) * (1 << k) for k in range(18)))
    media = [webp.store(webp.payload_of(t)) for t in texts]
    for t, m, x in zip(texts, media, webp.read_many(media), strict=True):
        assert x.tobytes() == webp.payload_of(t) and len(x) % 192 == 0 and len(x)
        if len(t) < 6000:
            px = webp.decode(m)
            assert px[..., 1].tobytes() == px[..., 0].tobytes() == px[..., 2].tobytes() == x.tobytes()
    monkeypatch.setattr(webp, "MAX_ROWS", 4)
    many = webp.store(webp.payload_of(texts[4]))
    assert len(webp.images_of(many)) > 5 and webp.read_many([many])[0].tobytes() == webp.payload_of(texts[4])


def test_broken_streams():
    good = webp.store(webp.payload_of(b"some text here"))
    for bad in (b"", good[:20], b"RIFX" + good[4:], good[:28]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_query(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5000), (4, "é" * 5000), (None, "x")]
    df = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id BIGINT, text STRING, media STRING")
    got = webp.query(df).collect()
    want = []
    for d, t in rows:
        p = webp.payload_of((t or "").encode())
        want.append((str(d), len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((str(x.doc_id), *x[1:5]) for x in got) == sorted(want)
    assert webp.query(df.limit(0)).count() == 0
    media = spark.createDataFrame([(1, bytearray(webp.store(b"a" * 192)), 5), (2, None, 6)], "id BIGINT, media BINARY, width INT")
    out = {x.id: x for x in webp.decode_column(media).collect()}
    assert (out[1].height, out[1].width) == (1, 192) and bytes(out[1].pixels[:4]) == b"aaa\xff" and out[2].pixels is None


def test_stored_streams_hold_back_references():
    """Copies near, far, longer than one copy may be, overlapping themselves and over chunk edges, read by both decoders."""
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 8))) for _ in range(n)).encode()
    base = text(70)
    texts = [b"", b"x" * 60_000, base * 6, base + text(4000) + base, text(300) + base[:50] + text(300) + base[20:90] + base, bytes(r.randrange(256) for _ in range(4000)), b"ab" * 500]
    payloads = [webp.payload_of(t) for t in texts]
    media = [webp.store(p) for p in payloads]
    assert [x.tobytes() for x in webp.read_many(media)] == payloads
    assert [b"".join(webp.decode(i)[..., 1].tobytes() for i in webp.images_of(m)) for m in media] == payloads
    found = [webp.copies(np.frombuffer(p, np.uint8)) for p in payloads]
    assert all(len(a) for a, _, _ in found) and max(n.max(initial=0) for _, n, _ in found) == webp.MAX_LENGTH
    for p, (start, length, far) in zip(payloads, found, strict=True):
        assert (start[1:] >= (start + length)[:-1]).all()
        for a, n, d in zip(start.tolist(), length.tolist(), far.tolist(), strict=True):
            assert all(p[k] == p[k - d] for k in range(a, a + n))
    assert len(media[2]) < len(media[5]) / 4


def parts_of(image):
    """Transforms and colour-cache bits of a stored image."""
    b, width, height = webp.open_stream(image)
    kinds = []
    while b.read(1):
        kinds.append(b.read(2))
        if kinds[-1] == webp.PREDICTOR:
            bits = b.read(3) + 2
            webp._pixels(b, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
        elif kinds[-1] == webp.PALETTE:
            webp._pixels(b, b.read(8) + 1, 1, False)
    return kinds, b.read(4) if b.read(1) else 0


def test_store_writes_every_part_that_helps():
    """Palette, predictor and colour cache stand in stored streams where they make them shorter, and are read back."""
    r = np.random.default_rng(8)
    rows, cols = np.indices((40, 192))
    smooth = ((np.sin(rows / 9) + np.cos(cols / 17)) * 60 + 128 + r.integers(0, 3, (40, 192))).astype(np.uint8).tobytes()
    local = b"".join(bytes(r.choice(r.integers(0, 256, 2), 60).astype(np.uint8)) for _ in range(128))
    few = {n: bytes(r.choice(np.arange(65, 65 + n), 7680, p=np.r_[0.8, np.full(n - 1, 0.2 / (n - 1))]).astype(np.uint8)) for n in (2, 4, 9)}
    text = " ".join("".join(chr(97 + c) for c in r.integers(0, 26, n)) for n in r.integers(1, 9, 600)).encode()
    payloads = [webp.payload_of(t) for t in (smooth, local, *few.values(), text, b"", b"a" * 3000)]
    media = [webp.store(p) for p in payloads]
    assert [x.tobytes() for x in webp.read_many(media)] == payloads
    assert all(webp.decode(m)[..., k].tobytes() == p for m, p in zip(media, payloads, strict=True) for k in (0, 1, 2))
    assert all((webp.decode(m)[..., 3] == 255).all() for m in media)
    found = [parts_of(m) for m in media]
    assert found[0][0] == [webp.SUBTRACT, webp.PREDICTOR] and found[1][0] == [webp.SUBTRACT] and found[1][1] in webp.CACHES
    assert [webp.PALETTE] in [x for x, _ in found[2:5]] and found[5] == ([webp.SUBTRACT], 0)
    for m, p in zip(media, payloads, strict=True):
        plain = webp._image(len(p) // webp.ROW, webp._green_step, np.frombuffer(p, np.uint8), 255)
        assert len(m) <= len(plain) and (len(m) == len(plain)) == (parts_of(m) == ([webp.SUBTRACT], 0))


def test_predictions_equal_the_decoder():
    r = np.random.default_rng(9)
    x = r.integers(0, 256, (5, 8)).astype(np.int16)
    got = webp.predictions(x)
    grey = lambda v: (255, 0, int(v), 0)
    for mode in range(14):
        for i in range(1, 5):
            for j in range(1, 8):
                want = webp._predict(mode, grey(x[i, j - 1]), grey(x[i - 1, j]), grey(x[i - 1, j - 1]), grey(x[i - 1, j + 1] if j < 7 else x[i, 0]))
                assert got[mode, i - 1, j - 1] == want[2] and tuple(want)[0] == 255 and tuple(want)[1] == tuple(want)[3] == 0, mode


def test_many_values_are_written_by_words():
    """``put_all`` writes the bits of ``put``, across words, with values of no bits and at any place; a cut prefix code is told."""
    r = np.random.default_rng(10)
    for n in (0, 1, 2, 700):
        sizes = r.choice([0, 1, 3, 11, 14, 32], n)
        values = r.integers(0, 1 << 32, n) & ((1 << sizes) - 1)
        one, many = webp.Writer(), webp.Writer()
        for w in (one, many):
            w.put(5, 3)
        for v, k in zip(values.tolist(), sizes.tolist(), strict=True):
            one.put(v, k)
        many.put_all(values, sizes)
        for w in (one, many):
            w.put(1, 2)
        assert (one.n, one.packed()) == (many.n, many.packed())
    lengths = webp.huffman(r.integers(1, 50, 280), webp.MAX_BITS)
    w = webp.Writer()
    webp.put_code(w, lengths)
    whole = webp.read_code(webp.Bits(w.packed()), 280)
    assert (np.bincount(whole.table, minlength=280) == 1 << (whole.bits - lengths)).all()
    with pytest.raises(ValueError):
        webp.read_code(webp.Bits(w.packed()[:40]), 280)
