"""License scans: a trained paragraph classifier, in DataFrame operations on its main path.

A text's units are its blocks (parted by blank lines, their lines joined, so
that a wrapped notice is whole), the lines, and the sentences of each block.
Units are classified by multinomial logistic regression over sparse word
unigrams and bigrams into licence families or ``unknown``: distinct units
explode into features that meet the weights in a broadcast equi-join (the
vocabulary is fixed by the notices), and sums per unit give the probabilities.
The predicted family is confirmed against its templates: the unit must hold at
least the share ``agreement`` of some template's bigrams. A long line that ends
in a notice is confirmed by it; a short line made of a few of a notice's words
is not.

Every unit that could be confirmed is classified. A confirmed one holds so many
of a template's bigrams that it must hold one of the few words in ``anchors()``
(chosen so that no template has enough bigrams without them), which a regular
expression tests first; this loses no result.

The model is fitted here, on notices made by rule from names and forms and on
headers and sentences written down, a share of which is left out of the fit: a
part to calibrate the temperature, a part for the tests. A family needs
``probability`` after that, else the unit is unknown.

Null and empty texts have no units. Every row is returned, repeated ones with
equal results; a text of any length is scanned whole; other columns are ignored;
an empty table gives an empty result. Identical units, however many, are scored
once; they meet by a digest, so a long one is no long key.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footgrid.llm.common import stored

UNKNOWN = "unknown"
#: Names of licences by family, as notices spell them, and their SPDX identifiers.
NAMES = {
    "Apache": (("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"), ("Apache-2.0",)),
    "MIT": (("MIT License", "MIT/X11 license", "Expat license"), ("MIT",)),
    "GPL": (("GNU General Public License, version 3", "GNU General Public License v2.0 or later", "GNU GPL", "GPL version 2 or later", "GPL version 3", "GPLv3 license"), ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later")),
    "LGPL": (("GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL version 3 or later", "LGPLv2.1 license"), ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later")),
    "AGPL": (("GNU Affero General Public License, version 3", "GNU AGPL", "AGPL version 3", "AGPLv3 license"), ("AGPL-3.0-only", "AGPL-3.0-or-later")),
    "BSD": (("BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-style license"), ("BSD-2-Clause", "BSD-3-Clause")),
    "MPL": (("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"), ("MPL-2.0",)),
    "CC-BY": (("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "CC BY 4.0", "CC BY 3.0 license"), ("CC-BY-3.0", "CC-BY-4.0")),
    "CC-BY-SA": (("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 4.0", "CC BY-SA 3.0 license"), ("CC-BY-SA-3.0", "CC-BY-SA-4.0")),
    "CC-BY-NC": (("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 3.0 Unported License", "CC BY-NC 4.0", "CC BY-NC 3.0 license"), ("CC-BY-NC-3.0", "CC-BY-NC-4.0")),
    "public domain": (("CC0 1.0 Universal license", "CC0 license", "Unlicense"), ("CC0-1.0", "Unlicense")),
}
#: Usual forms of a notice that names a licence.
FORMS = (
    "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is released under the {}.",
    "Released under the {}.", "Released under the terms of the {}.", "This software is distributed under the terms of the {}.", "Text is available under the {}.",
    "Content is available under {}.", "Distributed under the {}, see the LICENSE file.", "Use of this source code is governed by the {} that can be found in the LICENSE file.",
    "You may use this file under the terms of the {}.", "This library is licensed under the {}.",
)
#: Usual wording of headers and of notices that name no licence.
HEADERS = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "public domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential.",
        "This software is licensed, not sold; you must accept the end user license agreement.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This file is subject to the terms of the end user license agreement.",
    ),
}
#: What forms name that is no licence, and sentences that grant nothing.
NO_LICENCES = ("new traffic act", "terms of the treaty", "cover of darkness", "old regime", "rules of the county", "name of a friend", "label of a rival", "city charter")
OTHERS = (
    "She renewed her driving license at the office last week.", "The council revoked the restaurant's liquor license.", "A fishing licence costs twelve pounds a year.",
    "The teacher gave them permission to leave early.", "You need permission from your parents to join the trip.", "The car comes with a three year warranty on parts.",
    "The warranty does not cover accidental damage.", "He wrote a book about the history of copyright law.", "Copyright disputes have become more common online.",
    "The detective obtained a search warrant for the house.", "The public domain of the kings was sold to the city.", "Their license plate was hidden by mud.",
    "The nurse is licensed to work in two states.", "Poetic license lets the author bend the facts.", "Rights reserved for the crown were listed in the charter.",
    "The license fee for television rises every year.", "Without permission nobody may enter the garden.", "The minister spoke about licensing of taxis.",
    "The software was slow and its source code was a mess.", "Free copies of the book were handed out at the fair.", "The conditions of the road were met with concern.",
    "The general told the public that the war was over.", "Creative people share what is common to all of them.", "The attribution of the painting to a pupil is disputed.",
    "An apache helicopter landed behind the school.", "Students of the institute built a robot that folds shirts.", "The foundation published a list of all its members.",
    "All rights of way across the field were closed in winter.", "The table was reserved for eight people.", "A version of the story is told in every village.",
    "The file on her desk held letters from the bank.", "Use of the pool is free for children.", "The terms of the contract were never made public.",
    "He was released from prison after nine years.", "Water was distributed to the villages by truck.", "The text of the speech is available at the library.",
)
#: Words too common to tell anything; used as anchors only where nothing else would do.
COMMON = frozenset("a all and any are as at be by can for from in is it may not of on or that the this to under with you".split())
WORD = "[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"


@dataclass(frozen=True)
class LicenseScan:
    probability: float = 0.6
    agreement: float = 0.6
    l2: float = 1e-3
    steps: int = 250


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def bigrams_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def features_of(words: list[str]) -> list[str]:
    """Distinct unigrams and bigrams."""
    return sorted({*words, *bigrams_of(words)})


@lru_cache(maxsize=1)
def notices() -> tuple[tuple[str, str], ...]:
    """(family, text) of every notice: forms with names, identifiers, headers; and texts of the class unknown."""
    named = [(f, form.format(name)) for f, (names, _) in NAMES.items() for name in names for form in FORMS]
    ids = [(f, f"SPDX-License-Identifier: {x}") for f, (_, spdx) in NAMES.items() for x in spdx]
    headers = [(f, text) for f, texts in HEADERS.items() for text in texts]
    # "The MIT License", not "an Unlicense license": whatever the grammar, words are what counts.
    others = [(UNKNOWN, form.format(x)) for x in NO_LICENCES for form in FORMS] + [(UNKNOWN, text) for text in OTHERS]
    return tuple(dict.fromkeys([*named, *ids, *headers, *others]))


def part_of(text: str) -> str:
    """Whether a text made by a form is for the fit, for calibration or for the tests; headers and sentences are for the fit."""
    if any(text in texts for texts in (*HEADERS.values(), OTHERS)) or text.startswith("SPDX"):
        return "fit"
    return {0: "calibrate", 1: "test"}.get(zlib.crc32(text.encode()) % 5, "fit")


def _shortened(words: list[str], k: int) -> list[str]:
    """The words without about every sixth, by a fixed rule."""
    kept = [w for i, w in enumerate(words) if zlib.crc32(f"{i} {w} {k}".encode()) % 6]
    return kept if len(kept) > 2 else words


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias)
        for f in features_of(words_of(text)):
            z = z + np.array(self.weights.get(f, np.zeros(len(z))))
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()


@lru_cache(maxsize=4)
def train(config: LicenseScan = LicenseScan()) -> Model:
    """Fit by full-batch gradient steps with momentum; the temperature is that of least loss on what the fit has not seen."""
    families = (UNKNOWN, *sorted({f for f, _ in notices()} - {UNKNOWN}))
    rows: dict[str, list] = {"fit": [], "calibrate": [], "test": []}
    for f, text in notices():
        words, part = words_of(text), part_of(text)
        rows[part] += [(families.index(f), words), (families.index(f), _shortened(words, 1))]
    names = sorted({x for _, words in rows["fit"] for x in features_of(words)})
    at = {f: i for i, f in enumerate(names)}

    def matrix(part):
        x = np.zeros((len(rows[part]), len(names) + 1), np.float32)
        for i, (_, words) in enumerate(rows[part]):
            x[i, [at[f] for f in features_of(words) if f in at]] = 1
        x[:, -1] = 1
        return x, np.eye(len(families), dtype=np.float32)[[r[0] for r in rows[part]]]

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix("fit")
    balance = (1 / y.sum(axis=0))[y.argmax(axis=1)][:, None] / len(families)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    speed = np.zeros_like(w)
    for _ in range(config.steps):
        speed = 0.9 * speed - (x.T @ ((softmax(x @ w) - y) * balance) + config.l2 * w)
        w = w + speed
    hx, hy = matrix("calibrate")
    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]
    loss = [-np.log((softmax(hx @ w / t) * hy).sum(axis=1) + 1e-12).mean() for t in grid]
    w = w.astype(np.float64).round(6)
    return Model(families, {f: tuple(w[i].tolist()) for f, i in at.items()}, tuple(w[-1].tolist()), grid[int(np.argmin(loss))])


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(family, distinct bigrams) of each notice."""
    return tuple(dict.fromkeys((f, tuple(sorted(bigrams_of(words_of(text))))) for f, text in notices() if f != UNKNOWN))


def needed(n: int, config: LicenseScan) -> int:
    """Bigrams of a template of ``n`` that a unit must hold."""
    return max(1, math.ceil(config.agreement * n - 1e-9))


@lru_cache(maxsize=4)
def anchors(config: LicenseScan = LicenseScan()) -> tuple[str, ...]:
    """Words of which a unit that agrees with any template holds at least one.

    Enough of each template's bigrams hold an anchor that those without one are
    fewer than a unit needs. Taken greedily, long words first of equal use.
    """
    spare = [[len(t) - needed(len(t), config) + 1, {frozenset(b.split()) for b in t}] for _, t in templates()]
    chosen: list[str] = []
    while any(short > 0 for short, _ in spare):
        use: dict[str, int] = {}
        for short, grams in spare:
            if short > 0:
                for word in {w for g in grams for w in g}:
                    use[word] = use.get(word, 0) + min(short, sum(word in g for g in grams))
        word = max(use, key=lambda w: (w not in COMMON, use[w] * len(w), w))
        chosen.append(word)
        for entry in spare:
            hit = {g for g in entry[1] if word in g}
            entry[0], entry[1] = entry[0] - len(hit), entry[1] - hit
    return tuple(sorted(chosen))


def _anchored(text: Column, config: LicenseScan) -> Column:
    """Whether a lower-cased text holds an anchor."""
    words = anchors(config)
    # What a whole word needs around it, and the first letter before the alternatives, to be quick.
    return text.rlike(f"(?<![a-z0-9])(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])")


def units(documents: DataFrame, config: LicenseScan = LicenseScan()) -> DataFrame:
    """(doc_id, text_hash, block, unit): one row a document with a null unit, and one for each unit that holds an anchor."""
    low = F.lower("text")

    def of_block(block: Column, i: Column) -> Column:
        joined = F.trim(F.regexp_replace(block, r"\s+", " "))
        every = F.array_distinct(F.concat(F.array(joined), F.split(block, "\n"), F.split(joined, r"(?<=[.!?;]) ")))
        return F.transform(F.filter(every, lambda u: _anchored(u, config)), lambda u: F.struct(i.alias("block"), u.alias("unit")))

    none = F.struct(F.lit(None).cast("int").alias("block"), F.lit(None).cast("string").alias("unit"))
    found = F.flatten(F.transform(F.split(low, r"\n[ \t\r]*\n"), of_block))
    every = F.when(_anchored(low, config), F.concat(F.array(none), found)).otherwise(F.array(none))
    rows = documents.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("text_hash"), F.explode(every).alias("u"))
    return rows.select("doc_id", "text_hash", "u.block", "u.unit")


def scored(distinct: DataFrame, config: LicenseScan = LicenseScan()) -> DataFrame:
    """(id, family, probability, agreement, confirmed) of distinct units (id, unit)."""
    spark, model = distinct.sparkSession, train(config)
    numbered = list(enumerate(templates()))
    held: dict[str, list[int]] = {}
    for i, (_, grams) in numbered:
        for g in grams:
            held.setdefault(g, []).append(i)
    # Bounded by the notices above: a few thousand features, a few hundred templates.
    zero = [0.0] * len(model.families)
    vocabulary = F.broadcast(spark.createDataFrame(
        [(f, list(model.weights.get(f, zero)), held.get(f, [])) for f in sorted({*model.weights, *held})], "feature string, w array<double>, templates array<int>"))
    sizes = F.broadcast(spark.createDataFrame([(i, f, len(g)) for i, (f, g) in numbered], "template int, family string, size int"))
    words = F.regexp_extract_all("unit", F.lit(f"({WORD})"), F.lit(1))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    features = distinct.select("id", words.alias("words")).select("id", F.explode(F.array_union(F.array_distinct("words"), pairs)).alias("feature")).join(vocabulary, "feature")
    n = len(model.families)
    sums = features.groupBy("id").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)])
    z = F.array(*[(F.col(f"z{i}") + model.bias[i]) / model.temperature for i in range(n)])
    families = F.array(*[F.lit(f) for f in model.families])
    classified = (
        sums.select("id", z.alias("z"))
        .withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
        .select("id", (F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"), F.element_at(families, F.array_position("e", F.array_max("e")).cast("int")).alias("best"))
    )
    agreed = (
        features.select("id", F.explode("templates").alias("template")).groupBy("id", "template").agg(F.count("*").alias("n")).join(sizes, "template")
        .groupBy("id", "family").agg(F.max(F.round(F.col("n") / F.col("size"), 6)).alias("agreement"))
    )
    sure = F.col("p") >= config.probability
    return (
        classified.join(agreed.withColumnRenamed("family", "best"), ["id", "best"], "left")
        .select("id", F.when(sure, F.col("best")).otherwise(F.lit(UNKNOWN)).alias("family"), F.round("p", 6).alias("probability"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"))
        .withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("agreement") >= config.agreement))
    )


def _scan(found: DataFrame, config: LicenseScan) -> DataFrame:
    rows = found.where("unit IS NOT NULL").withColumn("id", F.md5(F.col("unit").cast("binary")))
    return rows.join(scored(rows.groupBy("id").agg(F.first("unit").alias("unit")), config), "id").drop("id")


def scan(documents: DataFrame, config: LicenseScan = LicenseScan()) -> DataFrame:
    """(doc_id, text_hash, block, unit, family, probability, agreement, confirmed) of every unit that holds an anchor."""
    return _scan(stored(units(documents, config), "license-units"), config)


def apply(documents: DataFrame, config: LicenseScan = LicenseScan()) -> DataFrame:
    """(doc_id, n_notices, families, top_probability, licensed) of every row.

    n_notices: pairs of a block and a family confirmed in it; families: the
    confirmed ones, sorted and comma-joined; top_probability: theirs, else 0.
    """
    found = stored(units(documents, config), "license-units")  # ids and the units with an anchor: one scan of the texts
    at, nothing = ["doc_id", "text_hash"], [F.lit(None).cast("int").alias("block"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("probability")]
    rows = found.where("unit IS NULL").select(*at, F.lit(1).alias("own"), *nothing).unionByName(
        _scan(found, config).where("confirmed").select(*at, F.lit(None).cast("int").alias("own"), "block", "family", "probability"))
    return (
        rows.groupBy(*at).agg(
            F.count("own").alias("copies"), F.countDistinct("block", "family").alias("n_notices"),
            F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.coalesce(F.max("probability"), F.lit(0.0)).alias("top_probability"),
        )
        .select("doc_id", "n_notices", "families", "top_probability", (F.col("n_notices") > 0).alias("licensed"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .drop("copy")
    )
