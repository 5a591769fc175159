"""Quality classifier: document evidence combined with host and path posteriors.

A logistic model over text statistics, fitted on a bounded sample of labelled rows, gives each document
a log-likelihood ratio. Grouped sums of its probabilities give each host and each path a rate; a
path is shrunk toward its host and a host toward the global rate by prior weights that the spread
between groups determines (empirical Bayes). Evidence plus the path's log-odds is the posterior.

Cases: a null or empty text has zero statistics; null hosts or paths are a group of their own, apart from empty ones; with
no usable labels every document gets zero evidence and is kept; repeated rows each come out and each
count; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import cut

#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 20_000
KEEP_AT = 0.5
FEATURES = 12


def features(text: bytes | None) -> list[float]:
    """Statistics of one text; every one is a share or a logarithm."""
    t = text or b""
    if not t:
        return [0.0] * FEATURES
    c = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    n, upper, lower, digit = len(t), int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    blank, high = int(c[32] + c[9:14].sum()), int(c[128:].sum())
    words = t.split()
    lines = [x for x in t.split(b"\n") if x]
    m = max(1, len(words))
    mark = n - upper - lower - digit - blank - high
    return [
        upper / max(1, upper + lower), digit / n, mark / n, int(c[33]) / m, int(c[124]) / m, math.log1p(m), (n - blank) / m / 10,
        len(set(words)) / m, len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), int(c[46] + c[44]) / m, int(c[60] + c[62] + c[123] + c[125] + c[61]) / n,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(x) for x in b.column("text").cast(pa.binary()).to_pylist()]
        cols = [b.column(i) for i, name in enumerate(b.schema.names) if name != "text"]
        names = [x for x in b.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(rows, pa.list_(pa.float64()))], [*names, "x"])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (scaled features, bias last) by Newton steps with a ridge, and the log-odds of the sample."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], 1.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    rate = (y.sum() + 1) / (len(y) + 2)
    out = np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())
    return out, math.log(rate / (1 - rate))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _prior_weight(groups: DataFrame, rate: str, n: str) -> DataFrame:
    """One row: pseudo-counts by the method of moments from the spread of the groups' rates, at least 1 and at most
    10,000 (groups that differ no more than chance would shrink without end)."""
    g = F.sum(F.col(rate) * F.col(n)) / F.sum(n)
    within = F.count("*") * g * (1 - g) / F.sum(n)
    spread = F.sum(F.col(n) * F.col(rate) * F.col(rate)) / F.sum(n) - g * g
    between = F.greatest(spread - within, F.lit(1e-6))
    return groups.agg(F.least(F.greatest(g * (1 - g) / between, F.lit(1.0)), F.lit(1e4)).alias("weight"), g.alias("rate"))


def scores(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, posterior, keep) of every document."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    stats = cut(plain.mapInArrow(_statistics, "doc_id BIGINT, host STRING, path STRING, x ARRAY<DOUBLE>"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = cut(stats.join(known, "doc_id").select("x", "quality", F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("_o")))
    # A bounded sample, the same at every run: the smallest hashes. The bound on them, a tenth above what is
    # wanted, keeps what all partitions together send to the driver near ``fit_rows``.
    bound = int(2**32 * 1.1 * (fit_rows + 100) / max(1, labelled.count()))
    sample = labelled.filter(F.col("_o") < bound).orderBy("_o").limit(fit_rows).select("x", "quality").collect()
    y = np.array([r.quality for r in sample], float)
    if len(set(y.tolist())) == 2:
        w, prior = fit(np.array([r.x for r in sample]), y)
    else:
        w, prior = np.zeros(FEATURES + 1), 0.0
    terms = [F.lit(float(v)) * F.get("x", F.lit(i)) for i, v in enumerate(w[:-1])]
    logit = sum(terms, F.lit(float(w[-1])))
    clipped = F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))
    scored = cut(stats.select("doc_id", "host", "path", *(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(k) for c, k in (("host", "hk"), ("path", "pk"))), (clipped - F.lit(prior)).alias("evidence"), (1 / (1 + F.exp(-clipped))).alias("p")))
    paths = scored.groupBy("hk", "pk").agg(F.count("*").alias("n"), (F.sum("p") / F.count("*")).alias("r"))
    hosts = paths.groupBy("hk").agg(F.sum("n").alias("hn"), (F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("hr"))
    top = F.broadcast(_prior_weight(hosts, "hr", "hn").select(F.col("weight").alias("hw"), F.col("rate").alias("g")))
    low = F.broadcast(_prior_weight(paths, "r", "n").select(F.col("weight").alias("pw")))
    hosts = hosts.crossJoin(top).select("hk", ((F.col("hn") * F.col("hr") + F.col("hw") * F.col("g")) / (F.col("hn") + F.col("hw"))).alias("host_rate"))
    rates = paths.join(hosts, "hk").crossJoin(low).select("hk", "pk", "host_rate", ((F.col("n") * F.col("r") + F.col("pw") * F.col("host_rate")) / (F.col("n") + F.col("pw"))).alias("path_rate"))
    odds = F.col("evidence") + _logit(F.greatest(F.least("path_rate", F.lit(1 - 1e-6)), F.lit(1e-6)))
    joined = scored.join(cut(rates), ["hk", "pk"])
    return joined.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("posterior")).withColumn("keep", F.col("posterior") >= KEEP_AT)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, labels)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not rejected; all columns kept. Rows without doc_id stay."""
    bad = scores(docs, labels).filter(~F.col("keep") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").cast("bigint") == F.col("_bad"), "left_anti")
