"""Licence scans: a sparse word n-gram logistic regression over paragraphs, with an unknown class, confirmed by templates.

The model is trained on the driver, from the templates below and seeded variations of them, and from paragraphs of other
words for the class `unknown`; its size doesn't depend on the documents.  An n-gram of which all words are common is no
feature.  The threshold is calibrated on variations held out from training, so that at most `FALSE_RATE` of the unknown ones
pass.  Scanning is DataFrame operations only: paragraphs without a word of the features can only be unknown and
go first; the others' n-grams meet the weights, a table that the model bounds, and each paragraph's sums give its class.
A prediction stands if the share of a template's words in the paragraph, and of its word pairs, confirms it.

A paragraph is a line, or a group of neighbouring lines, since notices are wrapped.  Lines without a word (blank ones and
bare comment marks) part groups.  A group has so many lines that a notice of twice the longest template's words can be
spread over it, however narrow the lines are; of its first line only the last words count, and of its last one the first.
Of groups that overlap each other or a line that is a licence by itself, the most similar and then the shortest is found.

Null and empty texts have no paragraphs.  Equal paragraphs of one document are found each.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, is_key, numbered, pick

# fixed values: short notices and leading paragraphs of licence families
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this publication may be reproduced or transmitted without permission.",
    ),
}
COMMON = frozenset("a an and any as at be by for from in is it may not of on or other part that the this to use with without you can all are no".split())
FILLER = "work file text page author note section project code story house river open read share notice terms rights person copy source form public general version table list road water license licence copyright permission software free commons library foundation".split()
WORD = "[a-z0-9]+"
ORDERS = (1, 2, 3)
FALSE_RATE = 0.005
CONFIRM = 0.75


def words_of(text: str) -> list[str]:
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isascii() and ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in ORDERS for i in range(len(words) - n + 1)}


def is_feature(gram: str) -> bool:
    return not all(w in COMMON or w.isdigit() for w in gram.split())


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]  # the last is unknown
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    threshold: float

    def probabilities(self, text: str) -> list[float]:
        s = list(self.bias)
        for g in grams_of(words_of(text)):
            for k, w in enumerate(self.weights.get(g, ())):
                s[k] += w
        top = max(s)
        e = [math.exp(x - top) for x in s]
        return [x / sum(e) for x in e]

    def predict(self, text: str) -> str:
        p = self.probabilities(text)
        k = max(range(len(p)), key=lambda i: (p[i], -i))
        return self.classes[k] if p[k] >= self.threshold else "unknown"


def variations(rng: random.Random, each: int) -> list[tuple[str, str]]:
    """(paragraph, class): templates with words lost, added or around them; and paragraphs of other words."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            out.append((text, family))
            for _ in range(each):
                w = words_of(text)
                if len(w) > 4 and rng.random() < 0.5:
                    del w[rng.randrange(len(w))]
                front = rng.sample(FILLER[:16], rng.randint(0, 4)) + (["copyright", str(rng.randint(1990, 2030))] if rng.random() < 0.3 else [])
                out.append((" ".join([*front, *w, *rng.sample(FILLER[:16], rng.randint(0, 4))]), family))
    parts = [words_of(t) for texts in TEMPLATES.values() for t in texts]
    for _ in range(len(out)):
        w = [rng.choice(FILLER if rng.random() < 0.6 else sorted(COMMON)) for _ in range(rng.randint(3, 25))]
        if rng.random() < 0.5:  # a fragment of a template is not yet a licence
            p = rng.choice(parts)
            i = rng.randrange(len(p))
            w[2:2] = p[i : i + rng.randint(1, 2)]
        out.append((" ".join(w), "unknown"))
    return out


@lru_cache
def train(seed: int = 7, each: int = 12, epochs: int = 150, l1: float = 2e-4) -> Model:
    """Multinomial logistic regression by proximal gradient steps; L1 keeps it sparse."""
    rng = random.Random(seed)
    classes = (*TEMPLATES, "unknown")
    vocabulary = sorted({g for texts in TEMPLATES.values() for t in texts for g in grams_of(words_of(t)) if is_feature(g)})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(rows), len(at) + 1)), np.zeros((len(rows), len(classes)))
        for i, (text, family) in enumerate(rows):
            x[i, [at[g] for g in grams_of(words_of(text)) if g in at]] = 1
            x[i, -1], y[i, classes.index(family)] = 1, 1
        return x, y

    def softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(variations(rng, each))
    w, v, rate = np.zeros((x.shape[1], len(classes))), 0.0, 0.5
    for _ in range(epochs):
        g = x.T @ (softmax(x @ w) - y) / len(x)
        v = 0.9 * v - rate * g
        w = w + v
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * l1, 0)
    w = np.round(w, 4)
    held_x, held_y = matrix(variations(rng, each))
    p = softmax(held_x @ w)
    top = p[:, :-1].max(1)
    false = np.sort(top[(held_y[:, -1] == 1) & (p.argmax(1) < len(classes) - 1)])[::-1]
    allowed = int(FALSE_RATE * held_y[:, -1].sum())
    threshold = max(0.5, float(false[allowed]) + 1e-6 if len(false) > allowed else 0.5)
    weights = {g: tuple(map(float, w[i])) for g, i in at.items() if w[i].any()}
    return Model(classes, weights, tuple(map(float, w[-1])), round(min(threshold, 0.99), 6))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " "))).otherwise(words)


def _both(text: str) -> list[str]:
    """The distinct words and word pairs of a template."""
    w = words_of(text)
    return sorted({*w, *[" ".join(w[i : i + 2]) for i in range(len(w) - 1)]})


def _likeness(text: str) -> Column:
    """The share of a template's distinct words and word pairs that the paragraph has, too."""
    both = _both(text)
    return F.size(F.array_intersect(F.concat(F.col("words"), _pairs(F.col("words"))), _strings(both))) / F.lit(len(both))


def _once(df: DataFrame, *names: str, **columns: Column) -> DataFrame:
    """Some columns of df and new ones behind a generator, since filters would be pushed below and compute them again."""
    return df.select(*names, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _groups(docs: DataFrame, telling: list[str]) -> DataFrame:
    """doc_id, paragraph, lines, words: groups of two and more neighbouring lines that a template confirms."""
    most = 2 * max(len(words_of(t)) for texts in TEMPLATES.values() for t in texts)
    split = F.transform(F.split("text", "\n"), lambda x: F.regexp_extract_all(F.lower(x), F.lit(f"({WORD})"), F.lit(1)))
    ends = lambda w: F.struct(F.slice(w, 1, most - 1).alias("head"), F.when(F.size(w) < most, w).otherwise(F.slice(w, 1 - most, most - 1)).alias("tail"), F.size(w).alias("n"), F.exists(w, lambda x: x.isin(telling)).alias("telling"))
    cut = _once(docs.filter(F.col("text").contains("\n")), "doc_id", line=split)
    cut = _once(cut, "doc_id", line=F.transform("line", ends))
    cut = cut.filter(F.exists("line", lambda x: x.telling))
    following = lambda i: F.sequence(i, F.least(i + (most - 1), F.size("line") - 1))
    begins = F.filter(F.sequence(F.lit(0), F.size("line") - 2), lambda i: (F.col("line")[i].n > 0) & (F.col("line")[i + 1].n > 0) & F.exists(following(i), lambda k: F.col("line")[k].telling))
    cut = cut.select("doc_id", F.inline(F.transform(begins, lambda i: F.struct(i.alias("paragraph"), F.transform(following(i), lambda k: F.col("line")[k]).alias("near")))))
    # first and last line have a word of the notice each, the lines between them have no others
    none = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("inner"), F.lit(True).alias("open"))
    fits = lambda a, x: a.open & (x.n > 0) & (a.inner <= most - 2)
    reach = F.aggregate("near", none, lambda a, x: F.struct((a.lines + fits(a, x).cast("int")).alias("lines"), F.when(a.lines > 0, a.inner + x.n).otherwise(0).alias("inner"), fits(a, x).alias("open"))).lines
    cut = cut.select("doc_id", "paragraph", "near", F.explode(F.sequence(F.lit(2), reach)).alias("lines"))
    cut = cut.filter(F.exists(F.slice("near", 1, F.col("lines")), lambda x: x.telling))
    inner = F.flatten(F.transform(F.slice("near", 2, F.col("lines") - 2), lambda x: x.head))
    words = F.concat(F.col("near")[0].tail, inner, F.col("near")[F.col("lines") - 1].head)
    cut = _once(cut, "doc_id", "paragraph", "lines", words=words)
    templates = [_both(t) for texts in TEMPLATES.values() for t in texts]
    known = sorted({x for t in templates for x in t})
    held = F.array_distinct(F.filter(F.concat("words", _pairs(F.col("words"))), lambda x: x.isin(known)))
    cut = _once(cut, "doc_id", "paragraph", "lines", "words", held=held)
    # what a template has in common with the group is among `held`
    enough = lambda t: (F.size("held") >= CONFIRM * len(t)) & (F.size(F.array_intersect("held", _strings(t))) / F.lit(len(t)) >= CONFIRM)
    return cut.filter(reduce(or_, map(enough, templates))).drop("held")


def _apart(found: DataFrame) -> DataFrame:
    """Found lines, and of the groups that overlap those or each other, the most similar and then the shortest."""
    order = W.partitionBy("doc_id").orderBy("paragraph", "lines")
    reached = F.max(F.col("paragraph") + F.col("lines")).over(order.rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("new", (F.coalesce(reached, F.lit(0)) <= F.col("paragraph")).cast("int"))
    found = found.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    one = F.struct((F.col("lines") > 1).alias("group"), (-F.col("similarity")).alias("unlike"), "lines", "paragraph", "family", "probability", "similarity")
    every = found.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(one)).alias("found"))
    meets = lambda x, y: (x.paragraph < y.paragraph + y.lines) & (y.paragraph < x.paragraph + x.lines)
    kept = F.aggregate("found", F.slice("found", 1, 0), lambda a, x: F.when(F.exists(a, lambda y: meets(x, y)), a).otherwise(F.concat(a, F.array(x))))
    return every.select("doc_id", F.inline(kept))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), family, probability, similarity: each licence paragraph of each
    document.

    Null and empty texts have none.  Texts may have any length; what is compared is never longer than twice the longest
    template.  Repeated rows, and rows of one doc_id or without one, are scanned each by itself.  Of overlapping paragraphs
    a line goes before a group of lines, then the more similar, the shorter and the first one.  An empty table gives no rows.
    Columns but doc_id and text are ignored.
    """
    model = model or train()
    docs = pick(docs, doc_id="long", text="string")
    if is_key(docs):
        return _scan(docs, model)
    # as the rows of one doc_id would flow together below
    rows = numbered(Scratch(docs.sparkSession), docs, "row")
    found = _scan(rows.select(F.col("row").alias("doc_id"), "text"), model).withColumnRenamed("doc_id", "row")
    return found.join(rows.select("row", "doc_id"), "row").select("doc_id", *[c for c in found.columns if c != "row"])


def _scan(docs: DataFrame, model: Model) -> DataFrame:
    spark = docs.sparkSession
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = lines.select("doc_id", "paragraph", F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    telling = sorted({w for g in model.weights for w in g.split() if w not in COMMON and not w.isdigit()})
    lines = lines.filter(F.arrays_overlap("words", _strings(telling))).select("doc_id", "paragraph", F.lit(1).alias("lines"), "words")
    likeness = {name: F.greatest(*[_likeness(t) for t in texts], F.lit(0.0)) for name, texts in TEMPLATES.items()}
    lines = lines.unionByName(_groups(docs, telling))

    def grams(n: int) -> Column:
        if n == 1:
            return F.col("words")
        return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[grams(n) for n in ORDERS]))
    rows = lines.select("doc_id", "paragraph", "lines", "words", F.explode(every).alias("gram"))
    values = ", ".join(f"('{g}', array({', '.join(f'{x}D' for x in w)}))" for g, w in model.weights.items())
    weights = spark.sql(f"select col1 as gram, col2 as w from values {values}")
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(model.classes))]
    scored = rows.join(F.broadcast(weights), "gram").groupBy("doc_id", "paragraph", "lines").agg(F.first("words").alias("words"), *sums)

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    logits = F.array(*[F.col(f"s{k}") + F.lit(b) for k, b in enumerate(model.bias)])
    chances = let(logits, lambda s: let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp(x - top)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))))
    scored = scored.select("doc_id", "paragraph", "lines", "words", chances.alias("p"))
    scored = scored.withColumn("best", F.array_position("p", F.array_max("p")).cast("int")).withColumn("probability", F.array_max("p"))
    scored = scored.filter((F.col("best") < len(model.classes)) & (F.col("probability") >= model.threshold))
    family = _strings(model.classes)[F.col("best") - 1]

    similarity = F.lit(0.0)
    for name, like in likeness.items():
        similarity = F.when(F.col("family") == name, like).otherwise(similarity)
    out = scored.withColumn("family", family).withColumn("similarity", similarity).filter(F.col("similarity") >= CONFIRM)
    return _apart(out).select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))
