"""Licence scan: a trained paragraph classifier with an unknown class, confirmed against templates.

Paragraphs are the blocks between blank lines of a text, read in overlapping windows; their line breaks are spaces.
The features of a window are the word pairs that occur in template passages, so the model is as large as the templates
whatever the corpus. A multinomial logistic regression, fitted by Spark's own solver, learns the families from the
passages and the unknown class from windows of the corpus that share pairs with a template but hold no passage and are
not beside a licence word. Their distinct sets of pairs are counted over the whole corpus: the most frequent of one
half train, weighted by their counts, all others calibrate, family by family. A family stands if it is likelier
against the unknown class than in nearly all of them and enough pairs of one of its passages are there; a window can
name several. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compassframe.functions.barrier import settle
from compassframe.llm.common import Scratch, ascii_lower, attach, documents

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Passages of well-known licences and their notices: fixed values.
TEMPLATES = {
    "MIT": [
        "released under the MIT License", "licensed under the MIT license", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions",
    ],
    "Apache-2.0": [
        "licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "GPL": [
        "licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "LGPL": [
        "licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-or-later",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "licensed under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "licensed under CC BY 4.0", "licensed under CC BY-SA 4.0", "Creative Commons Attribution 4.0 International License",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC": [
        "licensed under CC BY-NC 4.0", "licensed under CC BY-NC-SA 4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "Proprietary": [
        "all rights reserved", "This material may not be reproduced without written permission of the publisher",
    ],
}
FAMILIES = list(TEMPLATES)
UNKNOWN = len(FAMILIES)
#: Families whose passages are also in texts of relatives: not named beside a relative's pair without a pair of their own.
RELATIVES = {
    "GPL": (["gnu general", "identifier gpl"], ["gnu lesser"]),
    "LGPL": (["gnu lesser", "identifier lgpl"], ["gnu general"]),
    "CC-BY": (["by 4", "by sa", "attribution 4", "attribution sharealike"], ["by nc", "attribution noncommercial"]),
}
#: Words that a paragraph for the unknown class and its neighbours must not have.
MARKS = ["license", "licensed", "licence", "licenses", "copyright", "redistribution", "permission", "cc", "reserved", "spdx"]
#: Distinct sets of pairs that train the unknown class at most (the most frequent of their half), and their weight together.
UNKNOWN_SETS, UNKNOWN_WEIGHT = 2_000, 250.0
#: Share of a passage's word pairs that has to occur in the window, and of unknown windows that a family must outdo.
CONFIRM, QUANTILE = 0.75, 0.99
#: Windows of two strides of pairs start every stride; no passage is longer than a stride.
STRIDE = 32
KEY = ["doc_id", "text_hash", "paragraph"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def word_pairs(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each pair of neighbouring words: keep, at (from 0) and pair."""
    spread = rows.select(*keep, "words", F.posexplode("words").alias("at", "first"))
    second = F.get("words", F.col("at") + 1)
    return spread.where(second.isNotNull()).select(*keep, "at", F.xxhash64("first", second).alias("pair"))


def numbers(values: list, kind: str) -> Column:
    """An array of constants as one literal, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class Templates:
    """passages (family, present) and the numbers of the word pairs in them."""

    def __init__(self, spark: SparkSession):
        texts = [(f, text) for f, name in enumerate(FAMILIES) for text in TEMPLATES[name]]
        rows = [F.struct(F.lit(f).alias("family"), F.lit(i).alias("passage"), F.lit(text).alias("text")) for i, (f, text) in enumerate(texts)]
        table = spark.range(1).select(F.inline(F.array(*rows))).select("family", "passage", words_of(F.col("text")).alias("words"))
        found: dict[tuple[int, int], set[int]] = {}
        for r in word_pairs(table, "family", "passage").collect():  # as many as TEMPLATES has
            found.setdefault((r.passage, r.family), set()).add(r.pair)
        hashes = sorted(set().union(*found.values()))
        index = {h: g for g, h in enumerate(hashes)}
        self.size = len(hashes)
        self.passages = [(f, sorted(index[h] for h in pairs)) for (_, f), pairs in sorted(found.items())]
        self.vocabulary = spark.range(1).select(F.posexplode(numbers(hashes, "bigint")).alias("gram", "pair"))
        names = sorted({n for sides in RELATIVES.values() for side in sides for n in side})
        hashed = spark.range(1).select(*[F.xxhash64(*map(F.lit, n.split())) for n in names]).first()
        of = {n: index[h] for n, h in zip(names, hashed, strict=True)}
        self.relatives = {FAMILIES.index(f): tuple([of[n] for n in side] for side in sides) for f, sides in RELATIVES.items()}

    def shares(self) -> Column:
        """Of each family, the share of its best passage that is in present."""
        best: list[list[Column]] = [[F.lit(0.0)] for _ in FAMILIES]
        for f, pairs in self.passages:
            best[f].append(F.size(F.array_intersect("present", numbers(pairs, "int"))) / F.lit(float(len(pairs))))
        return F.array(*[F.greatest(*x) for x in best])


def candidates(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Windows with a pair of the vocabulary: KEY, window, marked (a licence word in its or a neighbouring paragraph) and
    present (numbers of those pairs, in order)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(F.split("text", "\\n\\s*\\n"), words_of).alias("texts"))
    marks = F.array(*map(F.lit, MARKS))
    texts = settle(texts.select("*", F.transform("texts", lambda w: F.arrays_overlap(w, marks)).alias("marks")), ["texts", "marks"])
    there = lambda at: F.coalesce(F.get("marks", at), F.lit(False))
    near = F.transform("marks", lambda m, i: m | there(i - 1) | there(i + 1))
    blocks = texts.select("doc_id", "text_hash", F.posexplode(F.arrays_zip(F.col("texts").alias("words"), near.alias("marked"))).alias("paragraph", "x"))
    words = blocks.select(*KEY, F.col("x.words").alias("words"), F.col("x.marked").alias("marked"))
    found = word_pairs(words, *KEY, "marked").join(F.broadcast(vocabulary), "pair")  # as large as the templates
    last = F.floor(F.col("at") / STRIDE).cast("int")
    windows = F.when(last > 0, F.array(last - 1, last)).otherwise(F.array(last))
    return found.select(*KEY, "marked", "gram", F.explode(windows).alias("window")).groupBy(*KEY, "marked", "window").agg(
        F.sort_array(F.collect_set("gram")).alias("present"))


def unknown_sets(rows: DataFrame, templates: Templates) -> DataFrame:
    """present and n, how many windows have these pairs, of windows that nothing hints at a licence for."""
    sets = rows.where("NOT marked").groupBy("present").agg(F.count("*").alias("n"))
    return sets.where(F.array_max(templates.shares()) < CONFIRM)


def train(spark: SparkSession, templates: Templates, unknown: DataFrame) -> tuple[list[float], list[float]]:
    """Weights (families and the unknown class for each pair in turn) and intercepts; unknown: rows of present and n."""
    total = unknown.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    one = min(0.25, UNKNOWN_WEIGHT / max(1, total))
    known = [F.struct(F.lit(f).alias("family"), numbers(pairs, "int").alias("present"), F.lit(1.0).alias("weight")) for f, pairs in templates.passages]
    nothing = F.struct(F.lit(UNKNOWN).alias("family"), F.array().cast("array<int>").alias("present"), F.lit(0.25).alias("weight"))
    rows = spark.range(1).select(F.inline(F.array(*known, nothing)))
    rows = rows.unionByName(unknown.select(F.lit(UNKNOWN).alias("family"), "present", (F.col("n") * one).alias("weight")))
    indicator = F.transform(F.sequence(F.lit(0), F.lit(templates.size - 1)), lambda g: F.array_contains("present", g).cast("double"))
    rows = rows.select(F.col("family").cast("double").alias("label"), array_to_vector(indicator).alias("features"), "weight")
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, standardization=False, weightCol="weight").fit(rows)
    return [float(x) for x in fitted.coefficientMatrix.toArray().T.ravel()], [float(x) for x in fitted.interceptVector]


def margins(weights: list[float], intercepts: list[float]) -> Column:
    """Of each family, its log odds against the unknown class."""
    n = UNKNOWN + 1
    against = [w - weights[i // n * n + UNKNOWN] for i, w in enumerate(weights) if i % n != UNKNOWN]
    start = numbers([x - intercepts[UNKNOWN] for x in intercepts[:UNKNOWN]], "double")
    table = numbers(against, "double")
    return F.aggregate("present", start, lambda sums, g: F.zip_with(sums, F.slice(table, g * UNKNOWN + 1, UNKNOWN), lambda a, b: a + b))


def bars(sets: DataFrame, margin: Column) -> list[float]:
    """Of each family, the margin that QUANTILE of the windows (present, n) do not exceed, and 0 at least."""
    cells = sets.select("n", F.posexplode(margin).alias("family", "margin")).groupBy("family", F.floor(F.col("margin") * 50).alias("cell")).agg(
        F.sum("n").alias("n")).orderBy("family", "cell").collect()  # some thousand cells
    out = [0.0] * UNKNOWN
    for f in range(UNKNOWN):
        mine = [(r.cell, r.n) for r in cells if r.family == f]
        total, seen = sum(n for _, n in mine), 0
        for cell, n in mine:
            seen += n
            if seen >= QUANTILE * total:
                out[f] = max(0.0, (cell + 1) / 50)
                break
    return out


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, paragraph (from 0), window, licence, probability (against unknown) and share of what names a licence."""
    scratch, spark = Scratch(docs.sparkSession, "licences"), docs.sparkSession
    templates = Templates(spark)
    rows = scratch.put(candidates(docs, templates.vocabulary), "candidates")
    sets = scratch.put(unknown_sets(rows, templates).select("present", "n", F.xxhash64(F.lit(1), "present").alias("h")), "sets")
    half = sets.where(F.xxhash64(F.lit(2), "present") % 2 == 0)
    fitted = scratch.put(half.orderBy(F.desc("n"), "h", "present").limit(UNKNOWN_SETS), "fitted")
    weights, intercepts = train(spark, templates, fitted)
    margin = margins(weights, intercepts)
    least = bars(sets.join(F.broadcast(fitted.select("present")), "present", "left_anti"), margin)
    verdicts = F.arrays_zip(margin.alias("margin"), templates.shares().alias("share"), numbers(least, "double").alias("least"))
    judged = rows.where(F.array_max(templates.shares()) >= CONFIRM).select(*KEY, "window", F.posexplode(verdicts).alias("family", "x"))
    kept = judged.where((F.col("x.share") >= CONFIRM) & (F.col("x.margin") > F.col("x.least")))
    kept = kept.select(*KEY, "window", "family", (1 / (1 + F.exp(-F.col("x.margin")))).alias("probability"), F.col("x.share").alias("share"))

    asked = sorted({g for sides in templates.relatives.values() for side in sides for g in side})
    said = F.array_intersect("present", numbers(asked, "int"))
    said = rows.where(F.size(said) > 0).select(*KEY, F.explode(said).alias("gram")).groupBy(*KEY).agg(F.collect_set("gram").alias("said"))
    kept = attach(kept, scratch.put(said, "said"), KEY)
    for f, (own, others) in templates.relatives.items():
        has = lambda x: F.coalesce(F.arrays_overlap("said", numbers(x, "int")), F.lit(False))
        kept = kept.where((F.col("family") != f) | has(own) | ~has(others))
    names = F.array(*map(F.lit, FAMILIES))
    return kept.select(*KEY, "window", F.get(names, F.col("family")).alias("licence"), "probability", "share")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_paragraphs (that name a licence), licences (sorted, comma-joined), probability.

    Reads doc_id and text; null and empty texts name none, as do texts of punctuation. Repeated rows get equal
    results. probability is the largest of the document's paragraphs, null without any.
    """
    scratch, key = Scratch(docs.sparkSession, "licence-scan"), KEY[:2]
    found = licence_paragraphs(docs).groupBy(*key).agg(
        F.size(F.collect_set("paragraph")).cast("bigint").alias("n_paragraphs"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"),
        F.max("probability").alias("probability"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    return attach(rows, scratch.put(found, "found"), key).select(
        "doc_id", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("licences", F.lit("")).alias("licences"), "probability")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
