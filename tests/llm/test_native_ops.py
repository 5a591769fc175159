"""Line dedup, licences, mixing and the quality classifier against brute force."""

import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tickweave.llm import fuzzy_lines, licences, mixing, site_quality

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, at STRING, fp STRING, keep STRING, n STRING, host STRING"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None, "c", "c", "c", "c", "c") for d, t, lang, s in rows], DOCS)


def corpus():
    r = random.Random(11)
    line = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    base = [line(n) for n in (6, 12, 25, 40, 40, 60, 30)]
    docs = []
    for i in range(60):
        picked = []
        for x in r.sample(base, 3):
            w = x.split()
            if r.random() < 0.7:
                w[r.randrange(len(w))] = "zz" + str(r.randrange(4))
            x = " ".join(w)
            picked.append(x.upper() + "!" if r.random() < 0.2 else x)
        docs.append((i, "\n".join([line(9), *picked, "short one", "", line(3)]), "en", "a" if i % 3 else "b"))
    docs += [(100, None, None, None), (101, "", "en", "a"), (102, "\n\n", "en", "a"), (103, docs[0][1], "de", "b"), (None, docs[0][1], "en", "a"), (103, docs[0][1], "de", "b")]
    return docs


def norm(line):
    return [w for w in line.lower().translate(str.maketrans(fuzzy_lines.MARKS, " " * len(fuzzy_lines.MARKS))).split(" ") if w]


def brute_print(words):
    hs = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    return sum(1 << b for b in range(48) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute_lines(docs, near):
    """Every occurrence of a line of five words with its group under ``near`` (over all pairs, no fingerprint)."""
    occ = {(d, p): tuple(norm(x)) for d, t, *_ in docs if d is not None and t is not None for p, x in enumerate(t.split("\n")) if len(norm(x)) >= 5}
    keys = sorted(set(occ.values()))
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            a, b = " ".join(keys[i]), " ".join(keys[j])
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and near(a, b) <= 0.2 * max(len(a), len(b)):
                parent[find(i)] = find(j)
    group = {w: find(i) for i, w in enumerate(keys)}
    return {at: group[w] for at, w in occ.items()}


def check_lines(docs, got, near):
    """Share of the removable lines that went; fails where a line went that is not a later one of its group."""
    group = brute_lines(docs, near)
    first = {}
    for at, g in group.items():
        first[g] = min(first.get(g, at), at)
    gone = 0
    left = sorted(map(repr, got))
    for d, t, *_ in docs:
        if d is None or t is None:
            assert repr((d, t)) in left
            continue
        kept = next(x for i, x in got if i == d)
        if kept == t:
            continue
        have, lines = kept.split("\n") if kept else [], t.split("\n")
        for p, line in enumerate(lines):
            if have and have[0] == line:
                have.pop(0)
            else:
                assert (d, p) in group and first[group[d, p]] != (d, p), line
                gone += 1
        assert not have
    return gone / max(1, sum(1 for at, g in group.items() if first[g] != at))


def test_lines_against_all_pairs(spark):
    docs = corpus()
    frame_ = frame(spark, docs)
    got = fuzzy_lines.dedup(frame_)
    assert got.columns == [*frame_.columns, "n_removed"] and got.count() == len(docs)
    assert check_lines([x for i, x in enumerate(docs) if x not in docs[:i]], [(x.doc_id, x.text) for x in got.collect()], edits) >= 0.9


def test_recall_of_real_lines(spark):
    """Prose of the test tables: the share of removable lines that go, against all pairs by edit similarity."""
    import duckdb

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()]
    got = [(x.doc_id, x.text) for x in fuzzy_lines.dedup(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect()]
    con, grams = duckdb.connect(), {}

    def near(a, b):
        for x in (a, b):
            if x not in grams:
                grams[x] = {x[k : k + 4] for k in range(len(x) - 3)}
        if len(grams[a] & grams[b]) < 0.15 * max(len(grams[a]), len(grams[b])):
            return len(a) + len(b)
        return con.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0]

    assert check_lines(docs, got, near) >= 0.9


def test_lines_of_repeated_ids_and_no_rows(spark):
    shared = "this line of eight words stands in both"
    docs = [(1, shared), (5, f"{shared}\nsecond row of five own words here"), (5, f"totally other words that nobody else ever wrote down\n{shared}"), (5, f"totally other words that nobody else ever wrote down\n{shared}"), (9, "z " * 40000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id BIGINT, text STRING, gone STRING, own INT")
    got = sorted((x.doc_id, x.text) for x in fuzzy_lines.query(df).collect())
    second = "totally other words that nobody else ever wrote down"
    assert got == [(1, shared), (5, "second row of five own words here"), (5, second), (5, second), (9, "z " * 40000)]
    assert fuzzy_lines.dedup(df, every=True).columns == [*df.columns, "n_removed"]
    assert fuzzy_lines.query(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5, 127, 128, 700])
def test_native_simhash(spark, n):
    r = random.Random(n)
    words = [f"w{r.randrange(60)}" for _ in range(n)]
    got = spark.createDataFrame([(words,)], "w ARRAY<STRING>").select(fuzzy_lines.simhash(F.col("w")).alias("x")).first().x
    assert got == brute_print(words)


def test_native_simhash_lanes_agree(spark):
    df = spark.createDataFrame([([f"w{i % 37}" for i in range(100)],)], "w ARRAY<STRING>")
    n, h = F.size("w"), F.transform("w", lambda w: F.xxhash64(w))
    assert len(set(df.select(*[fuzzy_lines._majority(h, n, k).alias(str(k)) for k in (8, 16, 24)]).first())) == 1


def units(text):
    pieces = [p for line in (text or "").split("\n") for p in re.split(licences.BETWEEN, line) if p.strip(" ")]
    return [" ".join(pieces[i : i + k]) for i in range(len(pieces)) for k in range(1, licences.RUN + 1) if i + k <= len(pieces)]


def test_wrapped_and_embedded_notices(spark):
    """Every template, wrapped at several widths and inside a longer line, is found; other prose is left alone."""
    import textwrap

    docs, want = [], {}
    for kind, texts in licences.TEMPLATES.items():
        for t in texts:
            for width in (40, 75):
                docs.append((len(docs), "A first line.\n\n" + "\n".join(textwrap.wrap(t, width)) + "\n\nlast line", "en", "a"))
                want[len(docs) - 1] = kind
            docs.append((len(docs), f"Copyright 2020 Ann. {t} All other rights are those of Ann and of her heirs.", "en", "a"))
            want[len(docs) - 1] = kind
    docs += [(1000, "The license of the driver was taken away. He appealed under the law of the land, version after version.", "en", "a"), (1001, "MIT " * 30000, "en", "a")]
    got = {x.doc_id: x.licences for x in licences.query(frame(spark, docs)).collect()}
    assert got[1000] == got[1001] == ""
    assert all(kind in got[d].split(",") for d, kind in want.items())
    assert licences.query(frame(spark, [])).count() == 0


def test_licences(spark):
    docs = [(1, "some words here\nReleased under the MIT License.\nmore", "en", "a"), (2, "released under the MIT  licence", "en", "a"), (3, "LICENSED UNDER CC BY-NC 4.0\nLicensed under the Apache License, Version 2.0.", "en", "a"), (4, None, None, None), (5, "", "en", "b"), (6, "word " * 4000, "en", "b"), (7, "This work is licensed under the GNU General Public License, version 3", None, None), (7, "licence", None, None), (None, "x", None, None)]

    def brute(text):
        found = {}
        for line in units(text):
            w = line.lower().translate(str.maketrans(licences.MARKS, " " * len(licences.MARKS))).split()
            g = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
            for kind, texts in licences.TEMPLATES.items():
                for t in texts:
                    b = set(licences.template_bigrams(t))
                    if g and 2 * len(g & b) / (len(g) + len(b)) >= 0.8:
                        found[kind] = 1
        return ",".join(sorted(found))

    got = licences.query(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    by_id = {d: brute(t) for d, t, *_ in docs}
    by_id[7] = brute(docs[6][1])
    assert {x.doc_id: x.licences for x in got} == by_id and by_id[1] == "MIT" and by_id[3] == "Apache-2.0,CC-BY-NC-4.0"


def test_required_words_lose_no_match(spark):
    """Templates with words dropped, doubled and changed: every line that reaches the threshold comes out."""
    r, docs = random.Random(5), []
    for t in [t for texts in licences.TEMPLATES.values() for t in texts] * 40:
        w = t.split()
        for _ in range(r.randrange(1 + len(w) // 3)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["zzz"], [w[k], w[k]], [w[k].upper()]])
        docs.append((len(docs), " ".join(w), "en", "a"))
    grams = lambda x: {f"{a} {b}" for w in [x.lower().translate(str.maketrans(licences.MARKS, " " * len(licences.MARKS))).split()] for a, b in zip(w, w[1:], strict=False)}
    want = set()
    for d, x, *_ in docs:
        for kind, texts in licences.TEMPLATES.items():
            want |= {(d, kind) for t in texts for u in units(x) if 2 * len(grams(u) & grams(t)) >= 0.8 * (len(grams(u)) + len(grams(t))) - 1e-12 and grams(u)}
    got = {(x.doc_id, x.licence) for x in licences.matches(frame(spark, docs)).collect()}
    assert got == want and 200 < len(want) < 900


def test_mixing_meets_targets(spark):
    r = random.Random(2)
    docs = [(i, " ".join(["w"] * r.randrange(1, 30)), r.choice(["en", "de"]), "hot" if r.random() < 0.6 else f"s{r.randrange(3)}") for i in range(600)]
    docs += [(700, None, None, None), (701, "", "en", "hot"), (None, "a b", "en", "s1")]
    got = mixing.probabilities(frame(spark, docs)).collect()
    assert len(got) == len(docs) and {x.doc_id: x.tokens for x in got}[3] == len(docs[3][1].split())
    for m in ("m0", "m1"):
        have, want = defaultdict(float), defaultdict(float)
        for x in got:
            have[x[m]] += x.tokens * x.probability
            want[x[m]] += x.tokens
        z = sum(v**0.7 for v in want.values())
        for k, v in want.items():
            assert have[k] / sum(have.values()) == pytest.approx(v**0.7 / z, abs=2e-3)
    kept = mixing.sample(frame(spark, docs))
    assert kept.columns == DOCS.replace(" BIGINT", "").replace(" STRING", "").split(", ")
    share = kept.filter("doc_id < 600").count() / sum(x.probability for x in got if x.doc_id is not None and x.doc_id < 600)
    assert 0.8 < share < 1.2


def test_mixing_tokens_and_empty(spark):
    assert mixing.query(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([("a  b",), (" a\nb\tc ",), ("",), (" ",)], "t STRING").select(mixing.tokens(F.col("t")).alias("n"))
    assert [x.n for x in rows.collect()] == [3, 3, 0, 0]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = site_quality.scores(docs, fit).join(held, "doc_id").select("quality", "keep").collect()
    good = [x.keep for x in got if x.quality == 1]
    bad = [x.keep for x in got if x.quality == 0]
    print(sum(good) / len(good), 1 - sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.97 and 1 - sum(bad) / len(bad) > 0.9


def test_quality_cases(spark):
    docs = frame(spark, [(1, "a b", "en", "s"), (2, None, None, None), (2, None, None, None), (3, "", "en", "s"), (None, "x", "en", "s")])
    none = spark.createDataFrame([(1, None, 0), (9, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    got = site_quality.query(docs, none).collect()
    assert len(got) == 5 and all(x.keep and x.evidence == 0 for x in got)
    both = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 0, 0)], "doc_id BIGINT, quality INT, toxic INT")
    assert site_quality.keep_good(docs, both).columns == docs.columns
    assert site_quality.query(frame(spark, []), both).count() == 0 and site_quality.query(docs, none.limit(0)).count() == 5


def test_posteriors_equal_plain_shrinkage(spark):
    import math

    r = random.Random(6)
    rows = [(i, ("GOOD!! " if r.random() < 0.3 else "plain words here ") * r.randrange(1, 6), r.choice(["p", "q", None, ""]), r.choice(["a", "a", "a", "b", None, ""])) for i in range(400)]
    labels = [(i, int(rows[i][1].startswith("plain")), 0) for i in range(0, 400, 2)]
    got = site_quality.scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")).collect()
    rate = (sum(q for _, q, _ in labels) + 1) / (len(labels) + 2)
    p = {x.doc_id: 1 / (1 + math.exp(-max(-30, min(30, x.evidence + math.log(rate / (1 - rate)))))) for x in got}
    assert len({(x.host, x.path) for x in got}) == 16
    groups = defaultdict(list)
    for x in got:
        groups[x.host, x.path].append(p[x.doc_id])

    def weight(parts):
        n = sum(len(v) for v in parts)
        g = sum(map(sum, parts)) / n
        spread = sum(len(v) * (sum(v) / len(v)) ** 2 for v in parts) / n - g * g
        return min(max(g * (1 - g) / max(spread - len(parts) * g * (1 - g) / n, 1e-6), 1), 1e4), g

    hosts = defaultdict(list)
    for (h, _), v in groups.items():
        hosts[h] += v
    (hw, g), (pw, _) = weight(list(hosts.values())), weight(list(groups.values()))
    for x in got:
        host = (sum(hosts[x.host]) + hw * g) / (len(hosts[x.host]) + hw)
        path = (sum(groups[x.host, x.path]) + pw * host) / (len(groups[x.host, x.path]) + pw)
        odds = x.evidence + math.log(path / (1 - path))
        assert (x.host_rate, x.path_rate, x.posterior) == pytest.approx((host, path, 1 / (1 + math.exp(-odds))), abs=1e-9)
        assert x.keep == (x.posterior >= 0.5)


def test_rates_shrink(spark):
    r = random.Random(1)
    rows = [(i, ("GOOD!! " if i % 10 < 3 else "plain words here ") * 5, "p", "big") for i in range(200)] + [(500, "GOOD!! " * 5, "p", "tiny")]
    labels = spark.createDataFrame([(i, int(i % 10 >= 3), 0) for i in range(0, 200, 2)], "doc_id BIGINT, quality INT, toxic INT")
    rates = {x.host: x.host_rate for x in site_quality.scores(frame(spark, rows), labels).collect()}
    assert 0.05 < rates["tiny"] and abs(rates["big"] - 0.7) < 0.05 and r
    assert re.match("big|tiny", min(rates, key=rates.get))


def test_edit_similarity(spark):
    r = random.Random(8)
    pairs = []
    for _ in range(300):
        a = [r.choice(["ab", "b", "cde", "f"]) for _ in range(r.randrange(1, 12))]
        b = list(a)
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice([[], ["b"], ["xyz"]])
        if a != b and b:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a ARRAY<STRING>, b ARRAY<STRING>").select("a", "b", fuzzy_lines.similar(F.col("a"), F.col("b")).alias("x")).collect()
    want = [edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9 and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) for x, y in ((" ".join(r.a), " ".join(r.b)) for r in got)]
    assert [x.x for x in got] == want and any(want) and not all(want)


def test_counted_simhash_equals_expression(spark):
    words = [[f"w{(i * 7 + k) % 40000}x" for i in range(n)] for k, n in enumerate((5, 6, 40, 127, 128, 1000, 33000))]
    forms = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "node BIGINT, form STRING")
    rows = spark.createDataFrame(list(enumerate(words)), "node BIGINT, w ARRAY<STRING>")
    want = {r.node: r.fp for r in rows.select("node", fuzzy_lines.simhash(F.array_distinct("w")).alias("fp")).collect()}
    assert {r.node: r.fp for r in fuzzy_lines.prints(forms).collect()} == want


def test_line_words_split_at_every_mark(spark):
    line = "--  a" + "".join(f"Ab{m}{n}" for m in map(chr, range(128)) for n in ("", " ", "-") if m != "\n") + "É-ß"
    got = spark.createDataFrame([(line,)], "l STRING").select(F.trim(fuzzy_lines.normal(F.col("l"))).alias("w")).first().w
    assert got.split(" ") == [w for w in line.lower().translate(str.maketrans(fuzzy_lines.MARKS, " " * len(fuzzy_lines.MARKS))).split(" ") if w]


def test_similar_takes_equal_and_empty_lists(spark):
    rows = [(["a", "b"], ["a", "b"]), ([], []), (["a"], []), (["abcdefghi", "x"], ["abcdefghi"])]
    got = [r.x for r in spark.createDataFrame(rows, "a ARRAY<STRING>, b ARRAY<STRING>").coalesce(1).select(fuzzy_lines.similar(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [True, True, False, True]


def test_runs_without_a_required_word_are_not_built(spark):
    """A notice amid 4,000 short sentences: found, though few of the 48,000 runs are put together."""
    prose = [f"Ww{i} xx{i % 7} yy{i} zz." for i in range(4000)]
    text = " ".join([*prose[:2000], "Released under the MIT", "License. ", *prose[2000:]])
    rows = frame(spark, [(i, text, "en", "a") for i in range(8)])
    assert [x.licences for x in licences.query(rows).collect()] == ["MIT"] * 8
    assert licences.units(rows).count() < 8 * 200


def test_required_words_are_not_common_ones():
    for t in [t for texts in licences.TEMPLATES.values() for t in texts]:
        assert not {"by", "under"} & set(licences.required_words(t)), t
