"""SimHash groups, BPE and packed ids against brute force and the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tickweave.llm import byte_bpe, packed_ids, simhash_golay

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, fp STRING, key INT"


def words(r, n, pool=400):
    return " ".join(r.choice(["é", "w", "Q"]) + str(r.randrange(pool)) for _ in range(n))


def rows():
    r = random.Random(3)
    base = [words(r, n) for n in (5, 40, 300, 900, 2, 1)]
    texts = [*base, *base[:3], None, "", "  \n", "x" * 5000, base[2].upper(), "áb 'S don't  12 　 <|endoftext|>", "\x1cq\x85z  k"]
    for _ in range(60):
        t = base[r.randrange(2, 4)].split()
        t[r.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    out = [(i * 3, t, "en", "s", None, "clash", 1) for i, t in enumerate(texts)]
    return [*out, (0, texts[0], None, None, 0, None, None), (None, "no id", None, None, 0, None, None)]


def brute_print(t):
    w = [x for x in __import__("re").split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64(x, seed=42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(data):
    fps = [brute_print(t) for _, t in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, format(fps[i], "016x"), least.get(find(i)) if least.get(find(i)) is not None else -1) for i, (d, _) in enumerate(data))


def test_simhash_components(spark):
    data = rows()
    got = simhash_golay.query(spark.createDataFrame(data, DOCS)).collect()
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.fingerprint, x.component_id if x.component_id is not None else -1) for x in got)
    assert got == brute_components([(x[0], x[1]) for x in data])


def test_golay_decodes_every_word_within_three_bits():
    code, r = simhash_golay.golay(), np.random.default_rng(1)
    v = r.integers(0, 1 << 23, 20000, dtype=np.uint32)
    s = code.by_byte[0][v & 255] ^ code.by_byte[1][v >> 8 & 255] ^ code.by_byte[2][v >> 16 & 255]
    assert (np.bitwise_count(code.error[s]) <= 3).all()
    assert all(simhash_golay._syndrome_of(int(a ^ code.error[b])) == 0 for a, b in zip(v[:500], s[:500], strict=True))


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_golay_keys_meet(errors):
    r = np.random.default_rng(errors)
    a = r.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, errors, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, ia, oa = simhash_golay.search_keys(a)
    kb, ib, ob = simhash_golay.search_keys(b)
    probe, own = set(zip(ka.tolist(), ia.tolist(), strict=True)), zip(kb[ob].tolist(), ib[ob].tolist(), strict=True)
    assert len({i for k, i in own if (k, i) in probe}) == len(a)


def test_long_runs_keep_all_components():
    r = np.random.default_rng(5)
    f = np.unique(np.concatenate([np.uint64(c) ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)) for c in r.integers(0, 2**63, 5)]))
    a, b = simhash_golay.forest(f)
    assert len(a) == len(f) - 5 and all(bin(x ^ y).count("1") <= 3 for x, y in zip(a, b, strict=True))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash_golay.query(empty).count() == byte_bpe.query(empty).count() == packed_ids.query(empty).count() == 0


def library():
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark):
    data, lib = rows(), library()
    got = byte_bpe.query(spark.createDataFrame(data, DOCS)).collect()
    want = []
    for d, t, *_ in data:
        ids = lib.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda x: str(tuple(x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_bpe_long_matches_and_pieces(monkeypatch):
    r, lib = random.Random(9), library()
    enc = byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    long = "".join(r.choice("abcde") for _ in range(3000))
    for t in (long, "a" * 1000, "é" * 700, long + " " + long, "".join(chr(r.randrange(32, 70000)) for _ in range(3000) if True).encode("utf-8", "ignore").decode()):
        assert b"".join(enc.encode_texts([t])) == np.array(lib.encode_ordinary(t), "<u4").tobytes()
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 7)
    t = words(r, 500)
    assert list(enc.encode_texts([t, None, t])) == [np.array(lib.encode_ordinary(x), "<u4").tobytes() for x in (t, "", t)]
    assert enc.decode(next(enc.encode_texts([t]))) == t.encode()


def test_packed_equals_library(spark):
    data = [*rows(), (10**6, "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>, <|endoftext|>.\n<|endof text|>", *rows()[0][2:]), (10**6 + 1, "<|endoftext|>", *rows()[0][2:])]
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packed_ids.query(spark.createDataFrame(data, DOCS)).collect()
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for d, t, *_ in order:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
def test_packing_round_trip(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = r.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        assert (packed_ids.unpack(packed_ids.pack(ids, width), n, width) == ids).all()
    block = packed_ids.write_block([(4, ids[:10]), (None, ids[10:])], width)
    assert [(d, a, x.tolist()) for d, a, x in packed_ids.read_block(block)] == [(4, 0, ids[:10].tolist()), (None, 10, ids[10:].tolist())]
    assert all(packed_ids.read_id(block, i) == ids[i] for i in (0, 5, 999))


def test_ids_by_place(spark, tmp_path, monkeypatch):
    data = rows()
    out = str(tmp_path / "packed")
    packed_ids.write(spark.createDataFrame(data, DOCS).repartition(3), out, P.path("word_bpe_49k.json"), 2)
    ids = {}
    for r in packed_ids.index(spark, out).join(spark.read.parquet(out).select("shard", "first", "image"), ["shard", "first"]).collect():
        at = 0
        for _, a, x in packed_ids.read_block(r.image):
            ids |= {r.start + a + k: int(v) for k, v in enumerate(x)}
            at = a + len(x)
        assert at == r.n_ids
    assert sorted(ids) == list(range(len(ids)))
    for place in (0, len(ids) // 2, len(ids) - 1):
        assert packed_ids.read_at(spark, out, place) == ids[place]
    with pytest.raises(IndexError):
        packed_ids.read_at(spark, out, len(ids))


def test_pieces_of_long_texts_are_the_same(monkeypatch):
    enc, t = packed_ids.word_encoder(P.path("word_bpe_49k.json")), words(random.Random(4), 400)
    whole = enc.encode([t])
    monkeypatch.setattr(packed_ids, "PIECE", 50)
    assert enc.encode([t]) == whole


def test_words_equal_library_on_odd_characters():
    enc, r = packed_ids.WordEncoder(P.path("word_bpe_49k.json")), random.Random(1)
    pool = ["<|endoftext|>", "<|"] + list("aAbBzZ'sStTrRe.,;:!?|-_0129 \n\t ́İΣσéK²中\x1c\x85​힣")
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(2000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.lib.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
