"""Licence scans: a trained paragraph classifier whose predictions a template comparison confirms.

Texts are split at blank lines into paragraphs, whose wrapped lines are joined by a blank. Each
paragraph, and each line of one of several lines, as a notice may stand on a line of a longer
paragraph, is scored by a sparse logistic regression on word unigrams and bigrams with an
*unknown* class. Every bigram that the model knows holds a word that it knows, so a paragraph
without known words has the model's bias for its score and is unknown: none needs to be left
out, and only the others need n-grams. Probabilities are calibrated by a temperature set on
templates and corpus lines that the weights were not fitted on, by models finished as the one in
use is. A predicted family is confirmed when enough of one of its templates' word trigrams stand in
the paragraph or line, and where a template of another family differs by a few words, when it has
all words that this one alone has and none that only the other has.

The scan is a narrow projection of built-in functions: no Python on executors, no shuffle. The
model is trained on the driver from the templates and a bounded sample of the corpus's lines.

Defined results: a null or empty text has no paragraphs and no families. Repeated rows give
repeated rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Documents that the unknown class is learned from, two lines of each: the bound of the corpus sample.
SAMPLE_DOCUMENTS = 1500
#: Lines of the sample that cover more of a template are taken for notices and not learned as unknown.
LEAST_NOTICE = 0.2
LEAST_PROBABILITY = 0.5
#: A confirmed template has so large a share of its trigrams in the text, and so many or all of them.
LEAST_COVERED = 0.5
LEAST_TRIGRAMS = 4
#: Weights below this in every class are dropped from the model.
LEAST_WEIGHT = 0.05
FOLDS = 3

#: Short public notices of each family, which serve as training texts and templates.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Distributed under the terms of the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, and to permit persons to whom the Software is furnished to do so, without warranty of any kind.",
        "This project is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
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
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work and dedicated it to the public domain.",
    ],
}

#: Lines with words of licences that are no notices.
OTHERS = [
    "You need a driving license to rent the car.",
    "The license plate was found near the road.",
    "His fishing licence had expired in the spring.",
    "The warranty covers repairs for two years.",
    "They searched the house with a warrant.",
    "The poet took some license with the facts.",
    "Copyright is a subject of the second lecture.",
    "The bar lost its liquor license last year.",
    "Licensed nurses may apply for the position.",
    "Copyright 2020 the author.",
    "All rights reserved. Copyright by the publisher.",
    "The council will redistribute the funds.",
    "She works as a licensed electrician.",
    "The old maps are kept in the library.",
]

#: A word that so large a share of the sampled lines holds hints at no licence by itself.
MOST_COMMON = 0.01
#: Templates of two families that differ by so many words or fewer on either side are told apart by them.
NEAR_WORDS = 3

WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
_word = re.compile(WORD).findall


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def trigrams(text: str) -> list[str]:
    words = _word(text.lower())
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))})


def hints(lines: list[str] | None = None) -> list[str]:
    """The words that the model may know: those of the templates that few of the sampled lines hold."""
    found = sorted({w for v in TEMPLATES.values() for t in v for w in _word(t.lower())})
    held = Counter(w for line in lines or [] for w in set(_word(line.lower())))
    return [w for w in found if held[w] <= MOST_COMMON * len(lines or [])]


def told_apart(family: str, template: str) -> tuple[list[str], list[str]]:
    """Words that a text must hold, and words that it must not, for a template rather than a near one of another family."""
    own, needed, barred = set(_word(template.lower())), set(), set()
    for other, templates in TEMPLATES.items():
        for near in templates if other != family else []:
            words = set(_word(near.lower()))
            if own & words and len(own - words) <= NEAR_WORDS and len(words - own) <= NEAR_WORDS:
                needed |= own - words
                barred |= words - own
    return sorted(needed), sorted(barred)


def covered(template: list[str], three: set[str]) -> float:
    return len(three.intersection(template)) / len(template)


def examples(lines: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Training texts, classes and folds: templates whole, in part, and among ordinary words; ordinary lines as unknown.

    All texts made from one template are in one fold.
    """
    families = sorted(TEMPLATES)
    texts, labels, folds = [], [], []
    noise = [w for line in lines[:200] for w in line.split()[:20]] or ["project", "page", "section"]
    for k, family in enumerate(families):
        for at, template in enumerate(TEMPLATES[family]):
            words = template.split()
            for copy in range(18):
                extra = [noise[i] for i in rng.integers(0, len(noise), rng.integers(0, 6))]
                size = len(words) if copy < 4 else int(rng.integers(min(len(words), 5), len(words) + 1))
                begin = int(rng.integers(0, len(words) - size + 1)) if copy % 2 else 0
                texts.append(" ".join(extra[: len(extra) // 2] + words[begin : begin + size] + extra[len(extra) // 2 :]))
                labels.append(k)
                folds.append(at % FOLDS)
    known = [trigrams(t) for v in TEMPLATES.values() for t in v]
    for at, line in enumerate([*lines, *OTHERS * 6]):
        three = set(trigrams(line))
        if max(covered(t, three) for t in known) <= LEAST_NOTICE or at >= len(lines):
            texts.append(line)
            labels.append(len(families))
            folds.append((at if at < len(lines) else (at - len(lines)) % len(OTHERS)) % FOLDS)
    return texts, np.array(labels), np.array(folds), [*families, UNKNOWN]


class Sparse:
    """Rows of feature indexes."""

    def __init__(self, texts: list[str], known: dict[str, int]):
        found = [sorted(known[g] for g in grams(_word(t.lower())) if g in known) for t in texts]
        self.row = np.repeat(np.arange(len(texts)), list(map(len, found)))
        self.index = np.array([i for f in found for i in f], np.int64)
        self.n, self.size = len(texts), len(known)

    def scores(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, w[self.index, k], self.n) for k in range(len(b))], 1) + b

    def gradient(self, d: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.index, d[self.row, k], self.size) for k in range(d.shape[1])], 1)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fitted(x: Sparse, labels: np.ndarray, use: np.ndarray, classes: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the rows in use, by Adam with a pull to zero; unknown and all families together weigh the same."""
    w, b = np.zeros((x.size, classes)), np.zeros(classes)
    unknown = labels == classes - 1
    use = use / np.where(unknown, (use & unknown).sum(), (use & ~unknown).sum()).clip(1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    target = np.eye(classes)[labels]
    for step in range(1, steps + 1):
        d = (np.exp(log_softmax(x.scores(w, b))) - target) * use[:, None] / use.sum()
        for value, (m, v), g in zip((w, b), state, (x.gradient(d) + 1e-4 * w + 1e-5 * np.sign(w), d.sum(0))):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, b


def finished(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights in use: small ones dropped, and without any known word a text is unknown."""
    w, b = np.where(np.abs(w).max(1, keepdims=True) >= LEAST_WEIGHT, w, 0.0), b.copy()
    b[-1] = max(b[-1], b[:-1].max() + 1)
    return w, b


def train(lines: list[str], seed: int = 3) -> dict:
    """Weights of the known n-grams, biases, and the temperature that suits texts of left-out templates best."""
    rng = np.random.default_rng(seed)
    texts, labels, fold, classes = examples(lines, rng)
    hint = set(hints(lines))
    own = {g for v in TEMPLATES.values() for t in v for g in grams(_word(t.lower())) if hint.intersection(g.split())}
    known = {g: i for i, g in enumerate(sorted(own))}
    x = Sparse(texts, known)
    outside = np.zeros((len(texts), len(classes)))
    for f in range(FOLDS):
        outside[fold == f] = x.scores(*finished(*fitted(x, labels, fold != f, len(classes))))[fold == f]
    loss = {t: -float(log_softmax(outside / t)[np.arange(len(labels)), labels].mean()) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    w, b = finished(*fitted(x, labels, np.ones(len(texts), bool), len(classes)))
    kept = {g for g, i in known.items() if w[i].any()}
    used = {word for g in kept for word in g.split() if word in hint}
    weights = {g: [round(float(y), 4) for y in w[i]] for g, i in known.items() if g in kept}
    return {"classes": classes, "hints": sorted(used), "weights": weights, "bias": [round(float(y), 4) for y in b], "temperature": min(loss, key=loss.get)}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def hinted(words: Column, known: list[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*map(F.lit, known)).cast("array<string>"))) > 0


def sample_lines(docs: DataFrame) -> list[str]:
    """Of about ``SAMPLE_DOCUMENTS`` texts chosen by a hash the middle line and the first one with a word of a licence."""
    total = docs.count()
    share = F.lit(min(1 << 30, (1 << 30) * SAMPLE_DOCUMENTS // max(1, total)))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) <= share)
    parts = F.split("text", "\n")
    cut = lambda c: F.substring(c, 1, 400)
    middle = cut(F.element_at(parts, (F.size(parts) / 2).cast("int") + 1))
    first = cut(F.try_element_at(F.filter(parts, lambda p: hinted(words_of(p), hints())), F.lit(1)))
    rows = chosen.where(F.col("text").isNotNull()).select(F.explode(F.array_compact(F.array(middle, first))).alias("line"))
    return sorted(r["line"] for r in rows.limit(4 * SAMPLE_DOCUMENTS).collect())


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_paragraphs, families (confirmed), unconfirmed (and nowhere confirmed), best_probability.

    That is the greatest probability of a predicted family, 0 where none is predicted with ``LEAST_PROBABILITY``.
    """
    classes, t = model["classes"], model["temperature"]
    weights = F.from_json(F.lit(json.dumps(model["weights"])), "map<string,array<double>>")
    bias = F.array(*[F.lit(float(b)) for b in model["bias"]])
    listed = {k: [dict(zip(("three", "needed", "barred"), (trigrams(x), *told_apart(k, x)))) for x in v] for k, v in TEMPLATES.items()}
    templates = F.from_json(F.lit(json.dumps(listed)), "map<string,array<struct<three: array<string>, needed: array<string>, barred: array<string>>>>")
    names = F.array(*[F.lit(c) for c in classes])
    one, two = ([g for g in model["weights"] if g.count(" ") == k] for k in (0, 1))
    known = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    hint = lambda words: hinted(words, model["hints"])

    def joined(words: Column, n: int) -> Column:
        last = F.greatest(F.size(words) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    def logits(words: Column) -> Column:
        found = F.concat(F.array_intersect(words, known(one)), F.array_intersect(joined(words, 2), known(two)))
        return F.aggregate(F.transform(found, lambda g: F.try_element_at(weights, g)), bias, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))

    def softmax(z: Column) -> Column:
        up = F.transform(z, lambda y: F.exp((y - F.array_max(z)) / F.lit(float(t))))
        return F.transform(up, lambda y: y / F.aggregate(up, F.lit(0.0), lambda a, x: a + x))

    def judged(words: Column, prob: Column) -> Column:
        best = F.array_max(prob)
        family = F.element_at(names, F.array_position(prob, best).cast("int"))
        sure = (family != UNKNOWN) & (best >= LEAST_PROBABILITY)
        three = F.array_distinct(joined(words, 3))
        shared = lambda v: F.size(F.array_intersect(v, three))
        enough = lambda v: (shared(v) >= F.size(v) * F.lit(LEAST_COVERED)) & (shared(v) >= F.least(F.size(v), F.lit(LEAST_TRIGRAMS)))
        apart = lambda t: (F.size(F.array_except(t["needed"], words)) == 0) & ~F.arrays_overlap(t["barred"], words)
        confirmed = F.when(sure, F.coalesce(F.exists(F.try_element_at(templates, family), lambda t: enough(t["three"]) & apart(t)), F.lit(False))).otherwise(F.lit(False))
        return F.struct(family.alias("family"), best.alias("probability"), sure.alias("sure"), confirmed.alias("confirmed"))

    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.filter(F.split(text, r"\n[^\S\n]*\n\s*"), lambda p: F.trim(F.translate(p, "\n\r\t", "   ")) != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), parts.alias("parts"))
    rows = rows.select("doc_id", F.size("parts").alias("n_paragraphs"), F.filter("parts", lambda p: hint(words_of(p))).alias("parts"))
    lines = F.flatten(F.transform(F.filter("parts", lambda p: F.contains(p, F.lit("\n"))), lambda p: F.split(p, "\n")))
    rows = rows.select("doc_id", "n_paragraphs", F.array_union("parts", lines).alias("units"))
    rows = rows.select("doc_id", "n_paragraphs", F.filter(F.transform("units", words_of), hint).alias("words"))
    rows = rows.select("doc_id", "n_paragraphs", "words", F.transform("words", logits).alias("logits"))
    rows = rows.select("doc_id", "n_paragraphs", "words", F.transform("logits", softmax).alias("prob"))
    rows = rows.select("doc_id", "n_paragraphs", F.zip_with("words", "prob", judged).alias("found"))
    of = lambda test: F.array_distinct(F.transform(F.filter("found", test), lambda x: x["family"]))
    rows = rows.select("doc_id", "n_paragraphs", "found", of(lambda x: x["sure"] & x["confirmed"]).alias("families"), of(lambda x: x["sure"]).alias("predicted"))
    text_of = lambda families: F.array_join(F.array_sort(families), ",")
    return rows.select(
        "doc_id",
        "n_paragraphs",
        text_of("families").alias("families"),
        # a line of a confirmed paragraph needs no confirmation of its own
        text_of(F.array_except("predicted", "families")).alias("unconfirmed"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda x: F.when(x["sure"], x["probability"]))), F.lit(0.0)), 6).alias("best_probability"),
    )
