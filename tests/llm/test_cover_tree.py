import numpy as np
import pytest

from tickweave.llm import cover_tree


def brute(rows):
    v = [(i, lb, np.array(e, float) if e and None not in e and np.isfinite(e).all() and np.any(e) else None) for i, lb, e in rows]
    n, links = len(v), [0] * len(v)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            (a, la, x), (b, lb, y) = v[i], v[j]
            if x is None or y is None or la is None or la != lb or a is None or b is None or len(x) != len(y):
                continue
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (a, _, _) in enumerate(v):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted((str(a), links[i], str(least.get(find(i))), a is not None and a == least.get(find(i))) for i, (a, _, _) in enumerate(v))


@pytest.mark.parametrize("leaf", [4, 128])
@pytest.mark.parametrize("shape", ["clusters", "spread", "line", "equal"])
def test_pairs_of_trees(monkeypatch, shape, leaf):
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    monkeypatch.setattr(cover_tree, "TILE", 50)
    r = np.random.default_rng(leaf)
    base = {"clusters": r.normal(size=(25, 8))[r.integers(25, size=700)] + r.normal(size=(700, 8)) * 0.2, "spread": r.normal(size=(400, 40)), "line": np.c_[np.cos(np.arange(600) / 500), np.sin(np.arange(600) / 500)], "equal": np.ones((300, 3))}[shape]
    x = base / np.sqrt((base * base).sum(axis=1))[:, None]
    want = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    join = lambda parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    a, b = join(cover_tree.compare(base, None))
    assert len(a) == len(want) and {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == set(map(tuple, want.tolist()))
    a, b = join(cover_tree.compare(base[:200], base[200:]))
    assert {(p, q + 200) for p, q in zip(a.tolist(), b.tolist(), strict=True)} == {(p, q) for p, q in map(tuple, want.tolist()) if p < 200 <= q}
    if shape in ("clusters", "line"):
        assert max(map(len, cover_tree.Tree(x).members[1:])) < len(x)


@pytest.mark.parametrize("chunk", [40, 5000])
def test_equals_brute_force(spark, chunk):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    rows = []
    for i in range(300):
        x = base[r.integers(30)] + r.normal(size=16) * r.choice([0, 0.1, 0.25, 0.4])
        rows.append((i, int(r.choice([1, 1, 1, 2])), x.astype(np.float32).tolist()))
    rows += [(400, 1, None), (401, 1, []), (402, 1, [0.0] * 16), (403, 1, [float("nan")] * 16), (404, 1, [None] * 16), (405, None, rows[0][2]), (None, 1, rows[0][2]), (406, 1, rows[0][2][:8]), (5, 1, rows[5][2]), (5, 1, rows[5][2])]
    df = spark.createDataFrame([(a, e, lb, "x", "y") for a, lb, e in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, v STRING, rid STRING")
    got = cover_tree.near_duplicates(df, chunk=chunk).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in got) == brute(rows)
    assert cover_tree.query(df.limit(0)).count() == 0
