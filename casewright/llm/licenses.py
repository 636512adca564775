"""Licence scans: a trained paragraph classifier, confirmed by template comparison. SQL functions only.

The classes are licence families and `unknown`. Features are the word pairs that occur in the
templates below (binary, so a paragraph is a sparse vector). A softmax regression with an L1
penalty is trained on the templates, on variants of them with words left out, and, as unknown, on all
lines, and runs of three lines, of all distinct texts, and on all plain lines with a few words of
a notice put beside theirs. Paragraphs with the same features are one row with a count; every step
of the training sums over all distinct ones, by one aggregate as large as the model where they are more than LOCAL. The acceptance
threshold is calibrated on the unknown paragraphs kept from training (half of them, by hash), all of them:
at most FALSE of either kind would pass it. An accepted paragraph is confirmed if it shares CONFIRM of
the pairs of a template of that family, or of its own pairs.

A paragraph is a line, or, for notices that are wrapped, a run of up to SPAN lines none of which is
accepted by itself; of overlapping runs the one with the highest score counts. Scanning splits every
text into lines and those into word pairs; pairs meet the
model's pairs in a broadcast join (at most a few thousand rows, whatever the data), and only what
matches is grouped by paragraph. Pairs meet by 64-bit hash.

Defined results: null and empty texts have no paragraph and no licence; null doc_ids are reported
as such; repeated rows give repeated results; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.shared import staged, table

SPAN = 3
FALSE = 0.001
CONFIRM = 0.6
#: Lengths of runs of a notice's words that are put beside lines for the unknown class.
STRAY = (3, 4, 5)
#: A line that shares less than this with all templates takes such a run.
PLAIN = 0.2
SPLIT = "[^a-z0-9]+"
#: Steps of the training, their size, and the penalty.
STEPS, RATE, PENALTY = 60, 1.5, 2e-5
#: So many distinct features are summed by the driver in each step of the training; more are summed by the tasks.
LOCAL = 20_000
#: The threshold is a whole number of these.
GRAIN = 1_000_000

#: Usual notices and opening sentences of licence families.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT License.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0 Universal.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
FAMILIES = ["unknown", *TEMPLATES]


@dataclass(frozen=True)
class Model:
    """Pairs by number, weights (pair, family), biases, threshold."""

    pairs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    threshold: float


def words(text: str) -> list[str]:
    """As pairs_of in SQL: lower-cased runs of ASCII letters and digits."""
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(found: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(["^", *found], [*found, "$"])}


def pairs_of(paragraph: str) -> Column:
    """64-bit hashes of the word pairs of a paragraph with its start and end."""
    found = F.array_remove(F.split(F.lower(paragraph), SPLIT), "")
    return F.zip_with(F.concat(F.array(F.lit("^")), found), F.concat(found, F.array(F.lit("$"))), lambda a, b: F.xxhash64(a, b))


def _variants(text: str) -> list[set[str]]:
    """A notice, the same with single words left out, and with something before or after it."""
    found = words(text)
    out = [bigrams(found), bigrams(["copyright", "2020", *found]), bigrams([*found, "see", "the", "notice"])]
    for k in range(0, len(found), max(1, len(found) // 6)):
        out.append(bigrams(found[:k] + found[k + 1 :]))
    if len(found) >= 12:
        out += [bigrams(found[: len(found) // 2]), bigrams(found[len(found) // 2 :])]
    return out


def _strays() -> list[set[str]]:
    """Runs of a few words of a notice, which make no notice."""
    runs = [found[k : k + size] for texts in TEMPLATES.values() for found in map(words, texts) for size in STRAY for k in range(0, len(found) - size + 1, 2)]
    templates = [bigrams(words(t)) for texts in TEMPLATES.values() for t in texts]
    # Without the marks of start and end, as they stand beside other words.
    return [{f"{a} {b}" for a, b in zip(r, r[1:])} for r in runs if max(len(bigrams(r) & t) / min(len(r) + 1, len(t)) for t in templates) < CONFIRM]


PAIRS = sorted(set().union(*(bigrams(words(t)) for texts in TEMPLATES.values() for t in texts)))
NUMBER = {p: k for k, p in enumerate(PAIRS)}


def _ids(pairs: set[str]) -> list[int]:
    return sorted(NUMBER[p] for p in pairs if p in NUMBER)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, paragraph, lines, n, ids): the lines that hold pairs of PAIRS (their numbers in ids, sorted; n is how many
    pairs the line has), and the runs of SPAN lines of which several do."""
    named = docs.sparkSession.createDataFrame([(i, *p.split(" ")) for i, p in enumerate(PAIRS)], "id int, a string, b string")
    listed = F.broadcast(named.select("id", F.xxhash64("a", "b").alias("pair")))
    paragraphs = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(F.split("text", "\n")).alias("paragraph", "p")).where("p <> ''")
    paired = paragraphs.withColumn("pairs", pairs_of("p")).select("doc_id", "digest", "paragraph", F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))
    matched = paired.join(listed, "pair").groupBy("doc_id", "digest", "paragraph", "n").agg(F.collect_set("id").alias("ids"))
    single = matched.select("doc_id", "digest", "paragraph", F.lit(1).alias("lines"), "n", F.array_sort("ids").alias("ids"))
    first = F.explode(F.array(*(F.col("paragraph") - k for k in range(SPAN)))).alias("paragraph")
    runs = matched.select("doc_id", "digest", first, "n", "ids").groupBy("doc_id", "digest", "paragraph").agg(
        F.sum("n").cast("int").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.count("*").cast("int").alias("found")
    )
    return single.unionByName(runs.where("found > 1").select("doc_id", "digest", "paragraph", F.lit(SPAN).alias("lines"), "n", "ids"))


def _share(ids: str, n: Column) -> Column:
    """The largest share that a paragraph has in common with a template, of the shorter one's pairs."""
    listed = [_ids(bigrams(words(t))) for texts in TEMPLATES.values() for t in texts]
    return F.greatest(*(F.size(F.array_intersect(ids, F.array(*map(F.lit, x)))) / F.least(n, F.lit(len(x))) for x in listed))


def unknown(found: DataFrame) -> DataFrame:
    """(ids, hard, train, held): the distinct features of all paragraphs (candidates) that are no notices, and of plain lines with
    a run of a notice's words beside theirs (hard), with the number of paragraphs to train on and of those kept from it.
    Copies of a text count once. All lines with the same features take the same run of words."""
    once = found.groupBy("digest", "paragraph", "lines").agg(F.first("n").alias("n"), F.first("ids").alias("ids"))
    half = F.pmod(F.xxhash64("digest", "paragraph", "lines"), F.lit(2))
    counts = once.groupBy("ids", "n", "lines").agg(F.count_if(half == 0).alias("train"), F.count_if(half == 1).alias("held")).withColumn("share", _share("ids", F.col("n")))
    plain = counts.where((F.col("lines") == 1) & (F.col("share") < PLAIN))
    strays = F.array(*(F.array(*map(F.lit, _ids(s))) for s in _strays()))
    run = F.get(strays, F.pmod(F.xxhash64("ids"), F.size(strays)).cast("int"))
    # The run's words and their pairs with those beside them.
    hard = plain.withColumn("run", run).withColumn("n", F.col("n") + F.size("run") + 1).withColumn("ids", F.array_sort(F.array_union("ids", "run")))
    hard = hard.where(_share("ids", F.col("n")) < CONFIRM)
    rows = counts.where(F.col("share") < CONFIRM).select("ids", F.lit(False).alias("hard"), "train", "held").union(hard.select("ids", F.lit(True), "train", "held"))
    return rows.groupBy("ids", "hard").agg(F.sum("train").alias("train"), F.sum("held").alias("held"))


def _scores(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """rows (ids, ...) with z (a logit a family), top and mass: the probability of family k is exp(z[k] - top) / mass."""
    # A row of their own, as plans with thousands of constants are slow and fill the driver's memory.
    table = np.vstack([weights, bias]).T.tolist()
    row = F.broadcast(rows.sparkSession.createDataFrame([(table,)], "weights array<array<double>>"))
    logit = lambda k: F.aggregate("ids", F.col("weights")[k][len(weights)], lambda a, i: a + F.get(F.col("weights")[k], i))
    scored = rows.crossJoin(row).withColumn("z", F.array(*(logit(k) for k in range(len(FAMILIES))))).drop("weights")
    return scored.withColumn("top", F.array_max("z")).withColumn("mass", F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))


def _expected(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(pair or, last, bias; family): the sums of share * probability over rows (ids, share)."""
    out = np.zeros((len(PAIRS) + 1, len(FAMILIES)))
    of = [(F.col("share") * F.exp(F.col("z")[k] - F.col("top")) / F.col("mass")).alias(f"p{k}") for k in range(len(FAMILIES))]
    each = _scores(rows, weights, bias).select(F.explode(F.array_append("ids", F.lit(len(PAIRS)))).alias("id"), *of)
    for id_, *sums in each.groupBy("id").agg(*(F.sum(f"p{k}") for k in range(len(FAMILIES)))).collect():
        out[id_] = sums
    return out


def _summed(rows: DataFrame):
    """Gives (weights, bias) -> _expected of rows, which are read once if they are LOCAL or fewer."""
    if len(few := rows.limit(LOCAL + 1).collect()) > LOCAL:
        return lambda weights, bias: _expected(rows, weights, bias)
    listed = [[*r["ids"], len(PAIRS)] for r in few]
    size = np.array([len(ids) for ids in listed], np.int64)
    ids, starts, share = np.array([i for one in listed for i in one], np.int64), np.cumsum(size) - size, np.array([r["share"] for r in few])

    def expected(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        out = np.zeros((len(PAIRS) + 1, len(FAMILIES)))
        if few:
            z = np.add.reduceat(np.vstack([weights, bias])[ids], starts, axis=0)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p *= (share / p.sum(axis=1))[:, None]
            np.add.at(out, ids, np.repeat(p, size, axis=0))
        return out

    return expected


def _probabilities(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = x @ weights + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _vectors(found: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(found), len(PAIRS)))
    for i, ids in enumerate(found):
        x[i, ids] = 1
    return x


def fit(found: DataFrame, paragraphs: int) -> Model:
    """The model of all candidates; paragraphs is how many lines the distinct texts have, with pairs of PAIRS or without."""
    rows = staged(unknown(found), "licenses-unknown")
    sums = {h: (t, k) for h, t, k in rows.groupBy("hard").agg(F.sum("train"), F.sum("held")).collect()}
    with_pairs = found.where("lines = 1").select("digest", "paragraph").distinct().count()
    bare = max(0, paragraphs - with_pairs) / 2
    # Lines without any of the pairs are one vector, and with a run of a notice's words as many as there are runs.
    strays = [_ids(s) for s in _strays()]
    known = [(_ids(v), k + 1) for k, texts in enumerate(TEMPLATES.values()) for t in texts for v in _variants(t)]
    train, held = strays[::2], strays[1::2]
    x = _vectors([v for v, _ in known] + [[]] + train)
    y = np.zeros((len(x), len(FAMILIES)))
    y[np.arange(len(x)), [k for _, k in known] + [0] * (1 + len(train))] = 1
    # Families weigh the same in total, and as much as unknown does, half of which are runs in lines.
    size = y.sum(axis=0)
    weight = (y / np.maximum(1, size)).sum(axis=1) / (2 * len(TEMPLATES))
    plain, hard = bare + 20 + sums.get(False, (0, 0))[0], bare + len(train) + sums.get(True, (0, 0))[0]
    weight[len(known)] = (bare + 20) / plain / 4
    weight[len(known) + 1 :] = (bare / len(train) + 1) / hard / 4
    shares = rows.where("train > 0").select("ids", (F.col("train") / F.when(F.col("hard"), hard).otherwise(plain) / 4).alias("share"))
    target = np.vstack([x.T @ (y * weight[:, None]), (y * weight[:, None]).sum(axis=0)])
    if sums:
        for id_, share in shares.select(F.explode(F.array_append("ids", F.lit(len(PAIRS)))).alias("id"), "share").groupBy("id").agg(F.sum("share")).collect():
            target[id_, 0] += share
    unknown_sums = _summed(shares)
    v, ahead, t = np.zeros_like(target), np.zeros_like(target), 1.0
    for _ in range(STEPS):
        w, b = ahead[:-1], ahead[-1]
        p = _probabilities(x, w, b) * weight[:, None]
        expected = np.vstack([x.T @ p, p.sum(axis=0)]) + unknown_sums(w, b)
        new = ahead - RATE * (expected - target)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - RATE * PENALTY, 0)
        # Momentum, begun again where it leads away.
        if ((ahead - new) * (new - v)).sum() > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, ahead, t = new, new + (t - 1) / after * (new - v), after
    w, b = v[:-1], v[-1]
    best = lambda vectors: _probabilities(_vectors(vectors), w, b)[:, 1:].max(axis=1)
    passing = _passing(rows, w, b)
    return Model(PAIRS, w, b, max(
        _threshold(lambda low, high, parts: passing(False, low, high, parts), best([[]]), [bare + 20], sums.get(False, (0, 0))[1]),
        _threshold(lambda low, high, parts: passing(True, low, high, parts), best(held), [bare / len(held) + 1] * len(held), sums.get(True, (0, 0))[1]),
    ))


def _passing(rows: DataFrame, weights: np.ndarray, bias: np.ndarray):
    """Gives (hard, low, high, parts) -> {part: paragraphs kept from training whose score, in GRAINs, is in that part of low to high}."""
    score = F.array_max(F.transform(F.slice("z", 2, len(FAMILIES) - 1), lambda v: F.exp(v - F.col("top")) / F.col("mass")))
    scored = _scores(rows.where("held > 0"), weights, bias).select("hard", "held", F.floor(score * GRAIN).alias("at"))

    def counted(hard: bool, low: int, high: int, parts: int) -> dict[int, int]:
        inside = scored.where((F.col("hard") == hard) & (F.col("at") >= low) & (F.col("at") < high))
        return dict(inside.groupBy(F.expr(f"(at - {low}) div {(high - low) // parts}")).agg(F.sum("held")).collect())

    return counted


def _threshold(counted, scores: np.ndarray, weights: list[float], total: int) -> float:
    """The smallest number of GRAINs that at most FALSE of the paragraphs reach: those that counted() counts, total in all,
    and those of the scores, which weigh weights. Twice a thousandth is chosen, so a thousand counts are read at most."""
    allowed, at = FALSE * (total + sum(weights)), np.floor(scores * GRAIN).astype(np.int64)
    low, parts, width, above = 0, GRAIN // 1000 + 1, 1000, 0.0
    while True:
        of = counted(low, low + parts * width, parts) if total else {}
        for part in range(parts - 1, -1, -1):
            start = low + part * width
            more = of.get(part, 0) + sum(w for s, w in zip(at, weights) if start <= s < start + width)
            if above + more > allowed:
                break
            above += more
        else:
            return low / GRAIN
        if width == 1:
            return (start + 1) / GRAIN
        low, parts, width = start, 1000, 1


def lines_of(docs: DataFrame) -> int:
    """How many lines the distinct texts have."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda p: p != ""))
    return docs.where("text IS NOT NULL").groupBy(F.xxhash64("text")).agg(F.first(lines).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def train(docs: DataFrame) -> Model:
    return fit(staged(candidates(docs), "licenses"), lines_of(docs))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, digest, paragraph, lines, family, score, overlap, confirmed) of every paragraph that a family
    accepts; paragraph is its first line, lines how many it has."""
    return judged(candidates(docs), model)


def judged(found: DataFrame, model: Model) -> DataFrame:
    """As scan, of candidates."""
    scored = _scores(found, model.weights, model.bias)
    scored = scored.withColumn("at", F.array_position("z", F.col("top")).cast("int")).withColumn("score", 1 / F.col("mass"))
    accepted = scored.where((F.col("at") > 1) & (F.col("score") >= model.threshold))
    near = Window.partitionBy("doc_id", "digest").orderBy("paragraph")
    alone = F.count_if(F.col("lines") == 1).over(near.rangeBetween(0, SPAN - 1)) == 0
    best = F.max(F.when(F.col("lines") > 1, F.struct("score", -F.col("paragraph")))).over(near.rangeBetween(1 - SPAN, SPAN - 1))
    accepted = accepted.withColumn("kept", (F.col("lines") == 1) | (alone & (F.struct("score", -F.col("paragraph")) == best))).where("kept").drop("kept")
    overlap = F.lit(0.0)
    for k, texts in enumerate(TEMPLATES.values()):
        shares = []
        for t in texts:
            grams = _ids(bigrams(words(t)))
            both = F.size(F.array_intersect("ids", F.array(*map(F.lit, grams))))
            shares.append(both / F.least(F.lit(len(grams)), F.col("n")))
        overlap = F.when(F.col("at") == k + 2, F.greatest(*shares)).otherwise(overlap)
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("at"))
    return accepted.select("doc_id", "digest", "paragraph", "lines", family.alias("family"), "score", overlap.alias("overlap"), (overlap >= CONFIRM).alias("confirmed"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paragraphs = staged(candidates(docs), "licenses")
    found = judged(paragraphs, fit(paragraphs, lines_of(docs))).groupBy("doc_id", "digest").agg(
        F.count("*").alias("accepted"),
        F.count_if("confirmed").alias("confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), "|").alias("families"),
        F.max("score").alias("score"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("paragraphs"))
    met = rows.alias("r").join(found.alias("f"), F.expr("r.doc_id <=> f.doc_id AND r.digest = f.digest"), "left")
    zero = F.lit(0)
    return met.select("r.doc_id", F.col("paragraphs").cast("long"), F.coalesce("accepted", zero).alias("accepted"), F.coalesce("confirmed", zero).alias("confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("score", F.lit(0.0)).alias("score"))
