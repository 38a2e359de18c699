"""Licence families of paragraphs, by a classifier that is trained here.

A sparse logistic regression over word n-grams (one to three words, presence; those that
occur in the texts below and aren't made of common words only) gives each paragraph a
family or "unknown"; its temperature and threshold are set on templates held out of
training. Paragraphs are the lines of a text; where several lines stand together, their
words are also classified in windows across the lines, for notices that are wrapped.
Longer lines are classified in windows too. A prediction is compared with the family's
templates in two ways: the share of the paragraph's word pairs that one of them has, and
the share of a template's pairs that the paragraph holds, which words around a licence
don't lessen.

A paragraph without any word of the model's n-grams has no features, which is classified
as unknown: such paragraphs are passed over, and nothing is lost by that.

Training happens on the driver over the fixed texts below (some hundred short
paragraphs). Scoring uses SQL functions only: the weights are an array literal, and
the hash (xxhash64, seed 42) is the one that Spark computes.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features, and steps and momentum of the descent.
FEATURES, STEPS, MOMENTUM = 4096, 300, 0.9
#: Words so common that n-grams of them alone are no features.
COMMON = frozenset("a all an and any are as at be but by can do for from has have if in into is it its may must no not of on one or other shall should so such that the this to under use used was were which will with without you your 0 1 2 3 4".split())
#: Word pairs of a paragraph that a template has to share, or of a template that a paragraph has to hold.
CONFIRM = 0.5
#: Words that are classified at once, and words from one such window of a longer line to the next.
WINDOW, STEP = 64, 32

# Names of licences as they are written, and lines from their notices.
NAMES = {
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "Affero General Public License v3.0 or later"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License version 2"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-2-Clause", "New BSD License", "3-clause BSD licence", "simplified BSD license"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC-BY-4.0", "CC BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial license", "CC BY-NC-ND 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution ShareAlike license"],
    "cc0": ["CC0 1.0", "Creative Commons Zero", "CC0 1.0 Universal", "CC0-1.0", "the public domain"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL v3", "GPL-3.0", "GNU General Public License, version 3 or later", "GPL v2", "GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPL-2.1", "GNU LGPL v3", "GNU Lesser General Public License v2.1 or later"],
    "mit": ["MIT License", "the MIT License", "MIT licence", "The MIT License (MIT)", "MIT"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License 2.0", "MPL 2.0"],
}
LEADS = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is distributed under the terms of the {}.", "Distributed under the {}. See LICENSE for details.", "SPDX-License-Identifier: {}", "License: {}", "This project is available under the {}.", "The code is published under the {} license.", "Content is made available under {}.", "You may use this file under the terms of the {}.", "Copyright (c) 2019 the authors. Licensed under the {}."]
NOTICES = {
    "agpl": ["You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc-by": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/", "This material may be shared for noncommercial purposes only under the Creative Commons license."],
    "cc-by-sa": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work has been dedicated to the public domain.", "This is free and unencumbered software released into the public domain."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see the GNU licenses page.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl": ["You should have received a copy of the GNU Lesser General Public License along with this library."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla site."],
    "reserved": ["All rights reserved.", "Copyright 2021. All rights reserved.", "Copyright (c) 2018 Example Inc. All rights reserved.", "All rights are reserved by the publisher.", "No part of this publication may be reproduced without prior written permission of the copyright holder.", "© 2020 The Authors. All rights reserved.", "Proprietary and confidential. All rights reserved.", "Unauthorized copying of this file is prohibited. All rights reserved."],
}
#: Paragraphs with words of licences that are none.
OTHERS = ["He lost his driving licence last year.", "A driver's license is required to rent a car.", "The restaurant has a liquor license.", "Ask for permission before you enter the room.", "She was licensed to practise medicine in two states.", "The police had no warrant to search the house.", "The machine comes with a two year warranty.", "Copyright law changed twice in that century.", "The council will redistribute the funds among the schools.", "A fishing licence costs twelve pounds.", "Please check your license plate number.", "They discussed copyright in the lecture.", "The warranty covers parts and labour.", "With the permission of the owner we crossed the field.", "The city issued a building permission.", "Copyright questions are hard to settle.", "The licence fee pays for television.", "His pilot license was revoked.", "The public domain of the king was large.", "An expired licence is not valid.", "Your software license key has expired, please renew.", "The license agreement was signed by both companies on Monday.", "poetic license", "They gave the teacher a warrant and a license."]


_APART = re.compile("[^0-9a-z\x80-\U0010ffff]+")


def words_of(text: str) -> list[str]:
    return [w for w in _APART.split(ascii_lower(text)) if w]


def ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@lru_cache(maxsize=1)
def known_grams() -> frozenset[str]:
    """The n-grams that are features: those of the templates and of OTHERS with a word that isn't common."""
    return frozenset(g for t in [*(x for lines in templates().values() for x in lines), *OTHERS] for g in grams_of(words_of(t)) if not COMMON.issuperset(g.split()))


def known_words() -> list[str]:
    """Words of which any feature has one."""
    return sorted({w for g in known_grams() for w in g.split()} - COMMON)


def features(text: str) -> list[int]:
    """Distinct hashed n-grams of one to three words, of those that are features."""
    grams = grams_of(words_of(text)) & known_grams()
    return sorted({(x - (1 << 64) if (x := xxhash.xxh64_intdigest(g.encode(), 42)) >> 63 else x) % FEATURES for g in grams})


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]  # the last is "unknown"
    weights: np.ndarray  # families x features
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        z = (self.weights[:, features(text)].sum(axis=1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def templates() -> dict[str, list[str]]:
    """Texts of each family that a paragraph is compared with."""
    out = {f: [lead.format(n) for n in names for lead in LEADS] for f, names in NAMES.items()}
    for f, lines in NOTICES.items():
        out.setdefault(f, []).extend(lines)
    return out


def examples(seed: int = 7) -> list[tuple[str, str, str]]:
    """(text, family, source) for training: templates, some with words around them, and what is none. The source is what a text is made of."""
    rng, known = random.Random(seed), templates()
    filler = sorted({w for x in OTHERS for w in words_of(x)} | set("the of and to in is was for with on that this from by are an".split()))
    invented = ["".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    run = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for family, lines in known.items():
        for line in lines:
            rows.append((line, family, line))
            rows.append((f"{run(invented, rng.randint(1, 6))} {line}", family, line))
            rows.append((f"{line} {run(invented + filler, rng.randint(1, 6))}", family, line))
    for line in OTHERS:
        rows += [(line, "unknown", line)] * 3 + [(f"{run(invented + filler, 5)} {line}", "unknown", line)] * 2
    for word, n in product(("license", "licence", "licensed", "copyright", "warranty", "permission", "warrant", "redistribute", "rights", "public domain", "mit", "version", "the", "apache", "general", "commons", "software", "terms", ""), range(12)):
        rows.append((f"{run(filler + invented, rng.randint(0, 9))} {word} {run(filler + invented, rng.randint(0, 9))}", "unknown", f"{word} {n}"))
    rows += [("", "unknown", "")] * 20
    return rows


def _fit(rows: list[tuple[list[int], int]], families: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (features, family) by gradient descent; families weigh alike; no weight for a feature never seen."""
    often = Counter((tuple(f), y) for f, y in rows)  # equal rows count as one of their weight
    found, y, n = [f for f, _ in often], np.array([y for _, y in often]), np.array(list(often.values()), float)
    used, feature = np.unique(np.concatenate([np.array(f, np.int64) for f in found]), return_inverse=True)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    by_feature = np.argsort(feature, kind="stable")
    full, row_starts = np.unique(row, return_index=True)  # rows without features have the bias only
    feature_starts = np.searchsorted(feature[by_feature], np.arange(len(used)))
    target = np.eye(families)[y]
    each = (n / np.bincount(y, n, minlength=families)[y] / families)[:, None]
    w, b = np.zeros((len(used), families)), np.zeros(families)
    v, c = w, b
    step = 4.0 * n.sum() / (len(row) * n.sum() / len(n) + n.sum())
    for _ in range(STEPS):
        z = np.tile(b, (len(found), 1))
        z[full] += np.add.reduceat(w[feature], row_starts)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * each
        v = MOMENTUM * v - step * (np.add.reduceat(g[row][by_feature], feature_starts) + 1e-5 * w)
        c = MOMENTUM * c - step * g.sum(axis=0)
        w, b = w + v, b + c
    weights = np.zeros((families, FEATURES))
    weights[:, used] = np.where(np.abs(w) < 0.02, 0, np.round(w, 4)).T
    return weights, np.round(b, 5)


def held_out() -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """The examples by source, four fifths and the rest: no template is in both."""
    rows = examples()
    sources = sorted({s for _, _, s in rows})
    random.Random(11).shuffle(sources)
    apart = set(sources[len(sources) * 4 // 5 :]) - {""}
    return [r for r in rows if r[2] not in apart], [r for r in rows if r[2] in apart]


@lru_cache(maxsize=2)
def model(whole: bool = True) -> LicenceModel:
    """The classifier. Fitted on four fifths of the templates, the others set temperature and threshold; then (``whole``) fitted on all."""
    train, held = held_out()
    families = (*sorted({f for _, f, _ in train + held} - {"unknown"}), "unknown")

    def encoded(rows):
        return [(features(text), families.index(f)) for text, f, _ in rows]

    w, b = _fit(encoded(train), len(families))
    y = np.array([families.index(f) for _, f, _ in held])
    z = np.array([w[:, features(text)].sum(axis=1) + b for text, _, _ in held])

    def loss(t: float) -> float:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return float(-np.log((p / p.sum(axis=1, keepdims=True))[np.arange(len(y)), y] + 1e-12).mean())

    temperature = min((0.25 * k for k in range(1, 17)), key=loss)
    p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    p /= p.sum(axis=1, keepdims=True)
    top, sure = p.argmax(axis=1), p.max(axis=1)
    unknown = len(families) - 1
    # The threshold with the fewest held-out errors, where what is below it counts as unknown; ties: the higher.
    threshold = max((0.05 * k for k in range(6, 19)), key=lambda t: (-int((np.where(sure >= t, top, unknown) != y).sum()), t))
    if whole:
        w, b = _fit(encoded(train + held), len(families))
    if b.argmax() != unknown:
        raise ValueError("a paragraph without features must be unknown")
    return LicenceModel(families, w, b, temperature, threshold)


def _literal(value, kind: str):
    """A constant of a nested type, as one JSON literal that Catalyst folds once."""
    return F.from_json(F.lit(json.dumps({"v": value}, ensure_ascii=False)), f"v {kind}")["v"]


def _grams(words, n: int):
    """n-grams of an array of words; none if it has fewer words."""
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(n))))


def find_licences(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``licences``: one struct for each paragraph and known family in it.

    paragraph (its number among the text's lines, from 0), family, probability, overlap
    (largest share of its word pairs in a template of the family), confirmed (overlap of
    CONFIRM or more), contained (largest share of a template's word pairs that it holds,
    of templates of which it holds a pair that no other family has) and wrapped. For a line
    of more than WINDOW words they are those of the family's best window. A family that only
    shows across lines that stand together (``wrapped``) is given with the number of the
    first of these lines, if it is confirmed or contained. Paragraphs classified as unknown
    are left out. By wrapped, then paragraph, then family. A null or empty text gives an
    empty array; repeated rows give the same; an empty table gives no rows. Of families
    with equal scores the first by name counts. SQL functions only, rows are independent:
    no exchange. A column named licences is replaced.
    """
    m = model()
    names, unknown = list(m.families), len(m.families) - 1
    weights = _literal([[float(x) for x in row] for row in m.weights], "array<array<double>>")
    bias = [float(x) for x in m.bias]
    known = templates()
    pairs = [[sorted(set(zip_pairs(words_of(t)))) for t in known.get(f, [])] for f in names]
    compared = _literal(pairs, "array<array<array<string>>>")
    families = Counter(p for f in pairs for p in {p for t in f for p in t})
    alone = _literal([[[p for p in t if families[p] == 1] for t in f] for f in pairs], "array<array<array<string>>>")
    vocabulary, grams = known_words(), sorted(known_grams())
    pieces = F.col("_licence_pieces")  # runs of lines that stand together
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda x: F.filter(F.split(x, "[^0-9a-z\\x{80}-\\x{10ffff}]+"), lambda w: F.length(w) > 0)
    any_known = lambda words: F.exists(words, lambda w: w.isin(vocabulary))
    # Each step is a column of its own: an expression used twice would be computed twice.
    step = documents.drop("licences").withColumn("_licence_pieces", F.split(F.regexp_replace(lower, "\n[ \t\r\f\x0B]+(?=\n)", "\n"), "\n\n", -1))
    step = step.withColumn("licences", F.filter(F.transform(pieces, lambda x, j: F.struct(j.cast("int").alias("piece"), split(x).alias("words"))), lambda x: any_known(x["words"])))
    lines = lambda x: F.filter(F.transform(F.split(F.get(pieces, x["piece"]), "\n", -1), lambda line, i: F.struct(x["piece"].alias("piece"), i.cast("int").alias("line"), F.lit(False).alias("wrapped"), split(line).alias("words"))), lambda x: any_known(x["words"]))
    across = lambda x: F.when(F.get(pieces, x["piece"]).rlike("[^\\s]\\s*\n\\s*[^\\s]"), F.array(F.struct(x["piece"].alias("piece"), F.length(F.regexp_extract(F.get(pieces, x["piece"]), "^\\n*", 0)).alias("line"), F.lit(True).alias("wrapped"), x["words"].alias("words")))).otherwise(F.array().cast("array<struct<piece:int,line:int,wrapped:boolean,words:array<string>>>"))
    step = step.withColumn("licences", F.flatten(F.transform("licences", lambda x: F.concat(lines(x), across(x)))))
    starts = lambda words: F.sequence(F.lit(0), F.floor((F.greatest(F.lit(1), F.size(words) - WINDOW + STEP) - 1) / STEP).cast("int"))
    where = lambda x: (x["piece"].alias("piece"), x["line"].alias("line"), x["wrapped"].alias("wrapped"))
    step = step.withColumn("licences", F.flatten(F.transform("licences", lambda x: F.transform(starts(x["words"]), lambda i: F.struct(*where(x), F.slice(x["words"], i * STEP + 1, WINDOW).alias("words"))))))
    step = step.withColumn("licences", F.filter("licences", lambda x: any_known(x["words"])))
    at = lambda words: F.array_distinct(F.transform(F.filter(F.concat(_grams(words, 1), _grams(words, 2), _grams(words, 3)), lambda g: g.isin(grams)), lambda g: F.pmod(F.xxhash64(g), F.lit(FEATURES)).cast("int")))
    step = step.withColumn("licences", F.transform("licences", lambda x: F.struct(*where(x), x["words"].alias("words"), at(x["words"]).alias("features"))))

    def score(found, k: int):
        return F.aggregate(found, F.lit(bias[k]), lambda a, i: a + F.get(F.get(weights, F.lit(k)), i)) / m.temperature

    scores = lambda found: F.array(*(score(found, k) for k in range(len(names))))
    step = step.withColumn("licences", F.transform("licences", lambda x: F.struct(*where(x), x["words"].alias("words"), scores(x["features"]).alias("z"))))
    step = step.withColumn("licences", F.transform("licences", lambda x: F.struct(*where(x), x["words"].alias("words"), (F.array_position(x["z"], F.array_max(x["z"])) - 1).cast("int").alias("top"), (F.lit(1.0) / F.aggregate(x["z"], F.lit(0.0), lambda a, z: a + F.exp(z - F.array_max(x["z"])))).alias("probability"))))
    step = step.withColumn("licences", F.filter("licences", lambda x: (x["top"] != unknown) & (x["probability"] >= m.threshold)))
    before = lambda x: F.aggregate(F.slice(pieces, 1, x["piece"]), F.lit(0), lambda a, p: a + F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 2)  # noqa: E731  lines before a piece
    step = step.withColumn("licences", F.transform("licences", lambda x: F.struct(*where(x), (before(x) + x["line"]).alias("paragraph"), F.array_distinct(_grams(x["words"], 2)).alias("pairs"), x["top"].alias("top"), x["probability"].alias("probability"))))
    overlap = lambda x: F.coalesce(F.array_max(F.transform(F.get(compared, x["top"]), lambda t: F.size(F.array_intersect(x["pairs"], t)) / F.greatest(F.lit(1), F.size(x["pairs"])))), F.lit(0.0))
    contained = lambda x: F.coalesce(F.array_max(F.zip_with(F.get(compared, x["top"]), F.get(alone, x["top"]), lambda t, own: F.when(F.arrays_overlap(x["pairs"], own), F.size(F.array_intersect(x["pairs"], t)) / F.greatest(F.lit(1), F.size(t))))), F.lit(0.0))
    step = step.withColumn("licences", F.transform("licences", lambda x: F.struct(*where(x), x["paragraph"].alias("paragraph"), x["top"].alias("top"), x["probability"].alias("probability"), overlap(x).alias("overlap"), contained(x).alias("contained"))))
    # The windows of a paragraph with one family side by side, the best of them first.
    rank = lambda x: F.struct(x["wrapped"].alias("wrapped"), x["paragraph"].alias("paragraph"), x["top"].alias("top"), (F.greatest(x["overlap"], x["contained"]) < CONFIRM).alias("unsure"), (-x["probability"]).alias("order"), (-x["contained"]).alias("less"), x["probability"].alias("probability"), x["overlap"].alias("overlap"), x["contained"].alias("contained"), x["piece"].alias("piece"))
    step = step.withColumn("licences", F.array_sort(F.transform("licences", rank)))
    last = lambda i: F.get("licences", i - 1)
    step = step.withColumn("licences", F.filter("licences", lambda x, i: (i == 0) | (last(i)["wrapped"] != x["wrapped"]) | (last(i)["paragraph"] != x["paragraph"]) | (last(i)["top"] != x["top"])))
    # Across lines only what no line of them has by itself.
    sure = F.transform(F.filter("licences", lambda x: ~x["wrapped"] & ~x["unsure"]), lambda x: F.struct(x["piece"].alias("piece"), x["top"].alias("top")))
    step = step.withColumn("_licence_lines", sure)
    step = step.withColumn("licences", F.filter("licences", lambda x: ~x["wrapped"] | ~x["unsure"] & ~F.array_contains("_licence_lines", F.struct(x["piece"].alias("piece"), x["top"].alias("top")))))
    family = F.array(*map(F.lit, names))
    return step.drop("_licence_pieces", "_licence_lines").withColumn("licences", F.transform("licences", lambda x: F.struct(x["paragraph"].alias("paragraph"), F.get(family, x["top"]).alias("family"), x["probability"].alias("probability"), x["overlap"].alias("overlap"), (x["overlap"] >= CONFIRM).alias("confirmed"), x["contained"].alias("contained"), x["wrapped"].alias("wrapped"))))


def zip_pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]

