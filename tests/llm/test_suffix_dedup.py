import hashlib
import random

import numpy as np
import pytest

from tickweave.llm import suffix_dedup as sd


def brute(docs):
    seen, out = {}, []
    for d, t in sorted((d, t) for d, t in {(d, t or b"") for d, t in docs if d is not None}):
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if (s := t[i : i + 100]) in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.setdefault(s, (d, i))
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(r.randrange(30, 200)) for _ in range(8)]
    docs = []
    for i in range(70):
        kind, b = r.randrange(6), r.choice(base)
        if kind == 0:
            t = text(60)
        elif kind == 1:
            t = b
        elif kind == 2:
            w = b.split(" ")
            w[r.randrange(len(w))] = "X"
            t = " ".join(w)
        elif kind == 3:
            a = r.randrange(len(b))
            t = text(20) + b[a : a + r.randrange(60, 260)] + text(20)
        elif kind == 4:
            t = b[r.randrange(50) :] + b[:200] + "ab" * r.randrange(200)
        else:
            t = r.choice(["", "short", "z" * r.randrange(90, 400), b[:100], b[:99], "q" + b[:100] + "r"])
        docs.append((r.randrange(10**6) if i % 2 else -i, t))
    return list({d: (d, t) for d, t in docs}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    rows = [(d, t, "en", "b", 1) for d, t in docs] + [(None, docs[0][1], None, None, None), (10**7, None, None, None, None), (docs[1][0], docs[1][1], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, data STRING, bucket INT").repartition(5)
    got = sorted(tuple(x) for x in sd.query(df).collect() if x.doc_id is not None)
    want = brute([(d, t.encode() if t is not None else b"") for d, t, *_ in rows])
    want.append(next(x for x in want if x[0] == docs[1][0]))
    assert got == sorted(want) and any(x[2] for x in got)
    assert sd.query(df.limit(0)).count() == 0
    kept = sd.remove_repeats(df, with_text=True).collect()
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in kept)


def test_suffix_sort():
    r = np.random.default_rng(4)
    buf = np.frombuffer(bytes(r.integers(97, 99, 3000).astype(np.uint8)) + b"a" * 400, np.uint8)
    s, at = sd.Suffixes(buf), np.sort(r.choice(3200, 700, replace=False))
    segment = np.sort(r.integers(0, 9, 700))
    got, data = s.sort(at, segment), buf.tobytes()
    want = [p for k in range(9) for p in sorted(at[segment == k].tolist(), key=lambda p: (data[p : p + 100], p))]
    assert got.tolist() == want


def test_texts_of_one_id_and_clashing_names(spark):
    """Different texts of one doc_id are compared like documents; the order among them is that of their hashes."""
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    docs = [(1, base[:150]), (5, base[100:300] + "x" * 30), (5, "y" * 20 + base[100:300]), (5, base[100:300] + "x" * 30), (7, "z" * 3_000_000)]
    df = spark.createDataFrame([(d, t, 1, "v", 0) for d, t in docs], "doc_id BIGINT, text STRING, ver INT, own STRING, th INT")
    got = sorted(tuple(x)[:4] for x in sd.query(df).collect())
    assert got[0] == (1, 150, 0, 0) and got[-1] == (7, 3_000_000, 2_999_999, 1)
    five = [x for x in got if x[0] == 5]
    assert len(five) == 3 and sorted(x[2] for x in five) in ([0, 0, 200], [0, 200, 200])


def test_texts_are_shuffled_only_where_needed(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(50)], "doc_id BIGINT, text STRING")
    assert {x.n_removed for x in sd.query(docs).collect()} == {0}
    plan = sd.query(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") >= 2 and "broadcast" in plan


def test_only_windows_that_stand_twice_are_sorted(monkeypatch):
    """Many blocks around one anchor: windows with a hash of their own are not sorted, and the result is that of all pairs."""
    r = random.Random(6)
    word = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    anchor, shared = word(32), word(168)
    texts = [word(68) + anchor + word(68) for _ in range(300)] + [word(30) + shared[:68] + anchor + shared[68:100] + word(38) for _ in range(3)]
    c = np.zeros(len(texts), sd.CONTEXT)
    c["doc"], c["off"], c["more"] = np.arange(len(texts)), 68, 68
    c["off"][300:], c["more"][300:] = 98, 98
    c["h"] = 5
    texts[300:] = [t[: 98 + sd.LENGTH] for t in texts[300:]]
    sizes, sort = [], sd.Suffixes.sort
    monkeypatch.setattr(sd.Suffixes, "sort", lambda self, at, segment: (sizes.append(len(at)), sort(self, at, segment))[1])
    rec, t = sd.repeated_windows(c, b"".join(texts))
    seen, want = set(), []
    for k, x in enumerate(texts):
        for i in range(int(c["more"][k]) + 1):
            s = x[i : i + sd.LENGTH]
            want += [(k, i)] if s in seen else []
            seen.add(s)
    assert want and sorted(zip(rec.tolist(), t.tolist(), strict=True)) == want
    assert sum(sizes) < 3 * len(want) < 300
