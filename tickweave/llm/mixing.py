"""Mixing to target weights with DataFrame functions only: iterative proportional fitting.

Token counts are summed by (source, language, topic) cell. Raking finds one factor per source, per
language and per topic so that the weighted cells meet the target share of each marginal. One scale
for all factors makes the expected tokens meet a budget: a document stays with the probability
min(1, scale * its cell's factor), decided by a hash of its id. A cell that reaches 1 is kept whole and
the others make up for it, so a rare cell does not lower the share that is kept of the rest; what such
a cell lacks to its target cannot be met without repeating documents.
Targets are the shares raised to a power below one and made to sum to one, which lifts small groups.
The topic is a parameter; where a table has none, the text's form stands in (see ``form_topic``).

Cases: a null source, language or topic is a value like any other; a null or empty text has no
tokens and its cell takes part with the tokens of the others (a cell without any tokens has factor
product as its marginals say); rows without doc_id stay or go together; repeated rows go the same way;
an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import cut

POWER, ROUNDS = 0.7, 200
#: Raking ends when every marginal share is this close to its target; ROUNDS ends it where targets contradict each other.
RESIDUAL = 1e-6
#: Share of all tokens to keep where no budget in tokens is given.
KEEP = 0.5
MARGINS = ("m0", "m1", "m2")


def form_topic(text: Column) -> Column:
    """A class of the text's form: listing, shouting, markup, figures or prose."""
    n = F.length(text) + F.lit(1)
    count = lambda c: n - 1 - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (
        F.when(count("|") * 60 > n, "listing").when(count("!") * 40 > n, "shouting").when(count("<") * 80 > n, "markup")
        .when(count("0") + count("1") + count("2") > n / 50, "figures").otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Blank-separated words: blanks are counted by length, as no list of words is needed."""
    t = F.trim(F.translate(text, "\n\t\r", "   "))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id: the first 48 bits of its MD5."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _prepared(docs: DataFrame, source: Column, lang: Column, topic: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    margins = [F.coalesce(c.cast("string"), F.lit("")).alias(m) for c, m in zip((source, lang, topic), MARGINS, strict=True)]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *margins, tokens(text).cast("bigint").alias("tokens"))


def _residual(cells: DataFrame) -> float:
    """The largest distance of a marginal share from its target."""
    worst = 0.0
    for m in MARGINS:
        share = cells.groupBy(m, f"t_{m}").agg(F.sum(F.col("n") * F.col("factor") / F.col("total")).alias("x"), F.sum("n").alias("n")).filter("n > 0")
        worst = max(worst, share.agg(F.max(F.abs(F.col("x") - F.col(f"t_{m}")))).first()[0] or 0.0)
    return worst


def rake(cells: DataFrame, power: float = POWER, rounds: int = ROUNDS) -> DataFrame:
    """(m0, m1, m2, n, factor) of each cell (m0, m1, m2, n).

    Every step sums weighted cells over one marginal; a cell is a combination of values, so what
    meets in a task is combinations, never documents. Steps are repeated until the targets are met to RESIDUAL.
    """
    total = cells.agg(F.sum("n").cast("double").alias("total"))
    now = cells.crossJoin(F.broadcast(total)).withColumn("factor", F.lit(1.0).cast("double"))
    for m in MARGINS:
        share = cells.groupBy(m).agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("s"))
        whole = F.broadcast(share.agg(F.sum("s").alias("z")))
        now = now.join(share.crossJoin(whole).select(m, (F.col("s") / F.col("z")).alias(f"t_{m}")), m)
    now = cut(now)
    for k in range(rounds):
        for m in MARGINS:
            sums = F.sum(F.col("n") * F.col("factor")).over(Window.partitionBy(m))
            step = F.when(sums > 0, F.col(f"t_{m}") * F.col("total") / sums).otherwise(1.0)
            now = now.withColumn("factor", F.col("factor") * step)
        if k % 4 == 3 or k == rounds - 1:
            now = cut(now)
            if _residual(now) <= RESIDUAL:
                break
    return now.select(*MARGINS, "n", "factor")


def scale_for(cells: DataFrame, budget: float | None = None) -> float:
    """The scale at which sum(n * min(1, scale * factor)) over the cells (n, factor) is ``budget``.

    Cells that reach 1 count whole, and the rest is shared out again until no further cell reaches 1.
    The sum is concave in the scale, so each step stays at or below the answer and whole cells stay whole.
    """
    full, scale = -1, 0.0
    while True:
        whole = F.col("factor") * F.lit(scale) >= 1
        part = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("double")
        got = cells.agg(F.count_if(whole).alias("full"), part(whole, F.col("n")).alias("held"), part(~whole, F.col("n") * F.col("factor")).alias("rest"), part(F.lit(True), F.col("n")).alias("total")).first()
        want = KEEP * got.total if budget is None else budget
        if want >= got.total or got.rest <= 0:
            return float("inf")
        if got.full == full:
            return scale
        full, scale = got.full, max(scale, (want - got.held) / got.rest)


def probabilities(docs: DataFrame, *, source: Column | None = None, lang: Column | None = None, topic: Column | None = None, power: float = POWER, budget: float | None = None) -> DataFrame:
    """(doc_id, m0, m1, m2, tokens, probability, kept) of every document; ``budget`` in tokens, KEEP of all by default."""
    source, lang = F.col("source") if source is None else source, F.col("lang") if lang is None else lang
    topic = form_topic(F.coalesce(F.col("text").cast("string"), F.lit(""))) if topic is None else topic
    rows = cut(_prepared(docs, source, lang, topic))
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("n")))
    factors = cut(rake(cells, power))
    scale = scale_for(factors, budget)
    chance = factors.select(*MARGINS, F.least(F.lit(1.0), F.col("factor") * F.lit(scale)).alias("probability"))
    joined = rows.join(chance, list(MARGINS))
    kept = F.coalesce(uniform(F.col("doc_id")), F.lit(0.0)) < F.col("probability")
    return joined.select("doc_id", *MARGINS, "tokens", "probability", kept.alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    found = probabilities(docs).withColumnsRenamed({"m0": "source", "m1": "lang", "m2": "topic"})
    return found.withColumn("probability", F.round("probability", 6))


def sample(docs: DataFrame) -> DataFrame:
    """The sampled documents; all columns kept. Rows without doc_id stay."""
    gone = probabilities(docs).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col("_gone"), "left_anti")
