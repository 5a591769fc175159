"""The token budget of mixing: met at any number of rare cells, with whole cells included."""

import pytest

from tickweave.llm import mixing

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING"


def corpus(spark, rare):
    docs = [(i, " ".join(["w"] * (5 + i % 40)), ("en", "en", "de")[i % 3], ("web", "web", "web", "book")[i % 4]) for i in range(600)]
    return spark.createDataFrame(docs + [(1000 + k, "two words", f"x{k}", f"new{k}") for k in range(rare)], DOCS)


@pytest.mark.parametrize("rare", [0, 1, 20])
def test_rare_cells_leave_the_kept_share(spark, rare):
    got = mixing.probabilities(corpus(spark, rare)).collect()
    expected, total = sum(x.tokens * x.probability for x in got), sum(x.tokens for x in got)
    assert expected / total == pytest.approx(mixing.KEEP, abs=1e-6)
    assert 0.45 < sum(x.tokens for x in got if x.kept) / total < 0.55
    assert all(x.probability == 1 and x.kept for x in got if x.doc_id >= 1000)


def test_budget_in_tokens(spark):
    docs = corpus(spark, 3)
    for budget in (700.0, 12000.0):
        assert sum(x.tokens * x.probability for x in mixing.probabilities(docs, budget=budget).collect()) == pytest.approx(budget, rel=1e-6)
    assert all(x.kept for x in mixing.probabilities(docs, budget=1e9).collect())


def test_equals_plain_fitting(spark):
    """Factors, scale and draw against a fitting by loops over the cells."""
    import hashlib
    import random
    from collections import defaultdict

    r = random.Random(4)
    docs = [(i, " ".join(["w"] * r.randrange(1, 30)) + r.choice(["", " | | | | |", " 2012 1201"]), r.choice(["en", "de", "fr"]), r.choice("aaab") + r.choice("xy")) for i in range(500)]
    docs += [(900, None, None, None), (901, "", "en", "ax")]
    got = mixing.probabilities(spark.createDataFrame(docs, DOCS)).collect()
    cells = defaultdict(float)
    for x in got:
        cells[x.m0, x.m1, x.m2] += x.tokens
    total, factor = sum(cells.values()), dict.fromkeys(cells, 1.0)
    target = []
    for m in range(3):
        share = defaultdict(float)
        for c, n in cells.items():
            share[c[m]] += n
        target.append({k: v**0.7 / sum(x**0.7 for x in share.values()) for k, v in share.items()})
    for _ in range(400):
        for m in range(3):
            have = defaultdict(float)
            for c, n in cells.items():
                have[c[m]] += n * factor[c]
            for c in cells:
                factor[c] *= target[m][c[m]] * total / have[c[m]] if have[c[m]] > 0 else 1.0
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * factor[c]) for c, n in cells.items()) < mixing.KEEP * total else (low, mid)
    for x in got:
        want = min(1, low * factor[x.m0, x.m1, x.m2])
        assert x.probability == pytest.approx(want, abs=1e-4)
        if abs(draw := int(hashlib.md5(str(x.doc_id).encode()).hexdigest()[:12], 16) / 2**48 - want) > 1e-3:
            assert x.kept == (draw < 0)
    assert len({x.m2 for x in got}) > 1
