"""Licence scans with DataFrame functions only: Dice coefficient over word bigrams.

A text is taken apart in pieces, its lines and the sentences in them, and every run of up to RUN pieces that
follow each other is a unit: a notice may be wrapped over lines or stand inside one. A unit is normalised to
words and compared with licence templates: twice the shared distinct bigrams over the sum of both counts. A template is only
compared when its size lets the coefficient reach the threshold. As a unit must share a certain number of a
template's bigrams, it must hold one of a few of its words; texts without such a word are not taken
apart, and a run of pieces is only put together if one of them has such a word and the run has no more different words than its template allows. A document's row has its best match of each licence kind.

Cases: a null or empty text, and one without a match, gives a row with no licences; repeated rows each
come out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Pieces of a unit at most, and the blanks behind the end of a sentence.
RUN, BETWEEN = 12, "(?<=[.!?;:]) +"
#: Notices by which texts commonly state their licence.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
}
#: Words that most texts hold: required last of all, as they tell texts apart least.
COMMON = {"a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with"}
MARKS = "!\"#$%&'()*+,-/:;<=>?@[\\]^_`{|}~\t\r."


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(line), MARKS, " " * len(MARKS)), " "), "")


def _bigrams(words: Column) -> Column:
    """Distinct bigrams; the list is bound as a variable, else every step would split the line again."""
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))
    grams = lambda w: F.when(F.size(w) > 1, F.array_distinct(pairs(w))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(words), grams), F.lit(0))


def template_bigrams(text: str) -> list[str]:
    words = text.lower().translate(str.maketrans(MARKS, " " * len(MARKS))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def required_words(text: str, threshold: float = THRESHOLD) -> list[str]:
    """Words of a template, longest first and common ones last, of which every line that reaches ``threshold`` holds one.

    A match shares at least m * t / (2 - t) of the template's m bigrams, so it cannot miss all
    bigrams that these words stand in.
    """
    grams = [tuple(g.split(" ")) for g in template_bigrams(text)]
    spare = math.floor(len(grams) * (1 - threshold / (2 - threshold)) + 1e-9)
    out, met = [], set()
    for w in sorted({w for g in grams for w in g}, key=lambda w: (w in COMMON or len(w) < 2, -len(w), w)):
        if len(met) > spare:
            break
        if new := {g for g in grams if w in g} - met:
            out.append(w)
            met |= new
    return out


def _bounds(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, list[str], float, float]]:
    """(licence, bigrams, least and most bigrams of a unit that can match) of every template."""
    grams = [(kind, template_bigrams(t)) for kind, texts in templates.items() for t in texts]
    return [(kind, g, len(g) * threshold / (2 - threshold) - 1e-9, len(g) * (2 - threshold) / threshold + 1e-9) for kind, g in grams]


def units(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line, words): the runs of pieces that may match."""
    bounds = [(a, b) for _, _, a, b in _bounds(templates, threshold)]
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = sorted({w for texts in templates.values() for t in texts for w in required_words(t, threshold)})
    one_of = lambda t: reduce(lambda x, y: x | y, [F.contains(t, F.lit(w)) for w in words], F.lit(False))
    holds = lambda c: F.exists(F.array(F.lower(c)), one_of)  # noqa: E731  lower case is worked out once
    needs = [(required_words(t, threshold), b) for (t, (_, b)) in zip([t for texts in templates.values() for t in texts], bounds, strict=True)]
    top = lambda w: reduce(F.greatest, [F.when(F.arrays_overlap(w, F.array(*map(F.lit, need))), F.lit(b)).otherwise(F.lit(-1.0)) for need, b in needs if need], F.lit(-1.0))
    piece = lambda line, i: F.transform(F.split(line, BETWEEN), lambda p: F.struct(i.alias("line"), p.alias("text")))
    found = F.filter(F.flatten(F.transform(F.split("text", "\n"), piece)), lambda p: F.trim(p["text"]) != "")
    worded = F.transform(found, lambda p: F.struct(p["line"].alias("line"), _words(p["text"]).alias("words")))
    # The most bigrams that a unit may have by the templates of which this piece holds a required word.
    pieces = F.transform(worded, lambda p: F.struct(p["line"], p["words"], top(p["words"]).alias("most")))
    lines = base.filter(holds("text")).select("doc_id", pieces.alias("ps")).filter(F.size("ps") > 0)
    low = min(a for a, _ in bounds)
    run = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size("ps") - i)), lambda k: F.slice("ps", i + 1, k))
    asked = lambda i: F.filter(run(i), lambda r: F.exists(r, lambda p: p["most"] > 0))
    joined = lambda r: F.struct(r[0]["line"].alias("line"), F.flatten(F.transform(r, lambda p: p["words"])).alias("words"), F.array_max(F.transform(r, lambda p: p["most"])).alias("most"))
    # Of d different words there are d - 1 different bigrams or more.
    fits = lambda u: (F.size(u["words"]) > low) & (F.size(F.array_distinct(u["words"])) - 1 <= u["most"])
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("ps") - 1), lambda i: F.filter(F.transform(asked(i), joined), fits)))
    return lines.select("doc_id", F.explode(every).alias("u")).select("doc_id", "u.line", "u.words")


def matches(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, dice, line): the units that match, by the line they begin on."""
    every = _bounds(templates, threshold)
    low, high = min(a for *_, a, _ in every), max(b for *_, b in every)
    sized = units(docs, templates, threshold).select("doc_id", "line", _bigrams(F.col("words")).alias("g")).withColumn("n", F.size("g")).filter(F.col("n").between(low, high))
    tests = []
    for kind, g, a, b in every:
        shared = F.size(F.array_intersect("g", F.array(*map(F.lit, g))))
        dice = F.when(F.col("n").between(a, b), 2.0 * shared / (F.col("n") + len(g)))
        tests.append(F.struct(F.lit(kind).alias("licence"), dice.alias("dice")))
    best = sized.select("doc_id", "line", F.explode(F.array(*tests)).alias("t"))
    return best.select("doc_id", "line", "t.licence", "t.dice").filter(F.col("dice") >= threshold)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_licences, licences, best_dice, first_line) of every document."""
    best = matches(docs).groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.min("line").alias("line"))
    found = best.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), F.count("*").alias("n_licences"), F.round(F.max("dice"), 6).alias("best_dice"), F.min("line").alias("first_line"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    joined = ids.join(found, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.coalesce("licences", F.lit("")).alias("licences"), "best_dice", "first_line")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)
