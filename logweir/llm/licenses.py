"""Licence notices by a trained paragraph classifier, native on the main path.

A softmax regression over hashed word uni- and bigrams tells licence families and an unknown class;
its temperature is calibrated on a held-out fold. A prediction stands only if the paragraph also
holds enough of the words of one of the family's templates. Lines are judged whole, and paragraphs, whose
line ends read as spaces, by overlapping windows, so that wrapped notices and notices within long lines count. Training takes place in the driver on
the fixed texts below; applying the model is column expressions alone: weights are array literals,
and an n-gram's weight is looked up by its crc32.
"""

from __future__ import annotations

import json
import operator
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 4096
WORD = r"[a-z0-9]+(?:[.][0-9]+)*"
UNKNOWN = "unknown"

# Short notices of each family, as they stand in files and pages.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["This software is released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Except where otherwise noted, content is available under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC-SA 4.0 for noncommercial use only.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Released under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["This package is released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
}
# Sentences that use such words without being a notice.
OTHER = [
    "She renewed her driver license before the trip.", "The museum granted a license to film inside the hall.", "Copyright law was the subject of the lecture.", "The apache helicopter landed near the village.",
    "Students at MIT built a small robot.", "The GNU project was announced in the eighties.", "Mozilla held its public meeting in the city.", "The software was tested on a large cluster.",
    "He asked permission to leave the room.", "The source code of the program is long.", "A free copy of the book was sent to any person who asked.", "The library is open to the general public.",
    "The fishing license costs ten dollars.", "Creative people share common attribution styles.", "Version 3 of the report was released last week.", "The terms of the contract were subject to change.",
    "The foundation published its work under a new name.", "Redistribution of wealth was debated in parliament.", "No warranty is offered on used cars.", "Licensed electricians must pass an exam.",
    "The attribution of the painting is doubtful.", "This file is subject to review.", "The license of the restaurant was revoked under the new law.", "All rights reserved.", "International trade is subject to version control.",
]
# Every template holds one of these; a line without any is no notice by itself.
ANCHORS = ["licen", "is hereby granted", "permission is hereby", "redistribution", "unencumbered", "cc by", "gpl"]
LEAST_OVERLAP = 0.6
CERTAIN = 0.75  # overlap from which a line stands whatever the rest of its paragraph holds
WINDOWS = (16, 32, 64)  # words; a window starts at every quarter


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower(), re.ASCII)


def slots(text: str) -> list[int]:
    w = words(text)
    return sorted({zlib.crc32(g.encode()) % DIMS for g in {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}})


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]
    weights: np.ndarray  # (families, DIMS), the temperature folded in
    bias: np.ndarray
    templates: tuple[tuple[tuple[str, ...], ...], ...]  # distinct words of each template, by family

    def predict(self, text: str) -> tuple[str, float, float]:
        """Family or unknown, calibrated probability, overlap; what the column expressions give."""
        z = self.bias + sum((self.weights[:, s] for s in self.grams(text)), np.zeros(len(self.families)))
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        have = set(words(text))
        overlap = max((len(have & set(t)) / len(t) for t in self.templates[k]), default=0.0)
        return (self.families[k] if overlap >= LEAST_OVERLAP else UNKNOWN), float(p[k]), overlap

    @staticmethod
    def grams(text: str) -> list[int]:
        w = words(text)
        return [zlib.crc32(g.encode()) % DIMS for g in dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])]


@lru_cache(1)
def train(seed: int = 11, copies: int = 16, steps: int = 400) -> LicenceModel:
    """Full-batch descent on the templates, varied by dropped and added words; temperature by a held-out fold."""
    rng = np.random.default_rng(seed)
    families = (*TEMPLATES, UNKNOWN)
    filler = sorted({w for t in OTHER for w in words(t)})
    rows, y = [], []
    for k, name in enumerate(families):
        for text in TEMPLATES.get(name, OTHER):
            for c in range(copies):
                w = words(text)
                if c:
                    w = [x for x in w if rng.random() > 0.1]
                    a, b = rng.integers(0, 6, 2)
                    w = [*rng.choice(filler, a), *w, *rng.choice(filler, b)]
                rows.append(slots(" ".join(w)))
                y.append(k)
    for _ in range(40 * copies):
        rows.append(slots(" ".join(rng.choice(filler, rng.integers(0, 30)))))
        y.append(len(families) - 1)
    x, y = np.zeros((len(rows), DIMS)), np.array(y)
    for i, r in enumerate(rows):
        x[i, r] = 1
    used = np.flatnonzero(x.any(axis=0))  # the other slots never get a weight
    x = x[:, used]
    fold = rng.random(len(y)) < 0.2
    goal = np.eye(len(families))[y]
    w, b = np.zeros((len(used), len(families))), np.zeros(len(families))
    xt, gt = x[~fold], goal[~fold]
    for _ in range(steps):
        z = xt @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - gt) / len(xt)
        w -= 2.0 * (xt.T @ d + 1e-5 * w)
        b -= 2.0 * d.sum(axis=0)
    z = x[fold] @ w + b

    def loss(t: float) -> float:
        s = z * t - (z * t).max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[fold]] - np.log(np.exp(s).sum(axis=1))).mean())

    t = min((0.25 * 1.15**k for k in range(24)), key=loss)
    templates = tuple(tuple(tuple(sorted(set(words(x)))) for x in TEMPLATES.get(f, [])) for f in families)
    full = np.zeros((len(families), DIMS))
    full[:, used] = (w * t).T
    return LicenceModel(families, full, b * t, templates)


def marks(templates: tuple) -> list[str]:
    """Words of which every text holds one that holds enough of a template: of each template as many as it may lack, and one."""
    plain = {w for t in OTHER for w in words(t)}
    out = set()
    for t in {t for family in templates for t in family}:
        lacking = len(t) - next(n for n in range(len(t) + 1) if n / len(t) >= LEAST_OVERLAP)
        out |= set(sorted(t, key=lambda w: (w in plain, len(w) < 3, -len(w), w))[: lacking + 1])
    return sorted(out)


def has_anchor(text: Column) -> Column:
    return F.exists(F.transform(F.array(text), F.lower), lambda low: reduce(operator.or_, (low.contains(a) for a in ANCHORS)))


def _constant(values: list, kind: str) -> Column:
    """An array that the optimiser folds into one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def notices(docs: DataFrame, least: float = 0.5, model: LicenceModel | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_notices, families (distinct, sorted), notices: an array of
    (paragraph from 0, family, probability, overlap), by paragraph, which is the number of a line.

    A line that is a notice by itself is one, unless it holds less than three quarters of a template and its paragraph, of which it is a part, holds more of another family's. A paragraph between blank lines gives its best window of each further
    family, at its first line; of windows that overlap, the one with more of a template decides the family.

    A null or empty text has none. Rows stay as they are, repeated ones and null ids too.
    """
    model = model or train()
    n = len(model.families)
    used = np.flatnonzero(np.abs(model.weights).max(axis=0) > 1e-4)
    rank = {int(s): i + 1 for i, s in enumerate(used)}  # a small table: slot -> row, 0: no weight
    where = _constant([rank.get(s, 0) for s in range(DIMS)], "int")
    tables = [_constant([0.0, *model.weights[f, used].tolist()], "double") for f in range(n)]

    def adds(weights: Column):
        return lambda s, i: s + F.element_at(weights, i)

    def once(value: Column, then) -> Column:
        """``then`` of the value, which is bound to a variable and so computed once."""
        return F.element_at(F.transform(F.array(value), then), 1)

    def pairs(w: Column) -> Column:
        return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.slice(w, 1, 0))

    def weighed(w: Column) -> Column:
        at = F.transform(F.array_distinct(F.concat(w, pairs(w))), lambda g: F.element_at(where, (F.pmod(F.crc32(g), F.lit(DIMS)) + 1).cast("int")) + 1)
        z = once(at, lambda a: F.array(*[F.aggregate(a, F.lit(float(model.bias[f])), adds(tables[f])) for f in range(n)]))
        return F.struct(w.alias("w"), z.alias("z"))

    gate = marks(model.templates)

    def marked(text: Column) -> Column:
        return once(F.lower(text), lambda low: reduce(operator.or_, (low.contains(g) for g in gate)))

    shortest = min(len(t) for f in model.templates for t in f)
    vocabulary = sorted({w for f in model.templates for t in f for w in t})

    def enough(w: Column) -> Column:
        """Whether the words hold enough of a template; of the words only those of templates meet each of them."""
        some = lambda d: reduce(operator.or_, (F.size(F.array_intersect(d, F.lit(list(t)))) >= LEAST_OVERLAP * len(t) - 1e-9 for f in model.templates for t in f))
        return once(F.array_intersect(w, F.lit(vocabulary)), lambda d: F.when(F.size(d) < LEAST_OVERLAP * shortest - 1e-9, F.lit(False)).otherwise(some(d)))

    def windows(w: Column) -> Column:
        """Windows of the words: (at, w). A paragraph that fits a smaller size has none of the next."""
        out = []
        for k, n in enumerate(WINDOWS):
            starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - n) / F.lit(n // 4))).cast("int"))
            cut = F.transform(starts, lambda i: F.struct((i * (n // 4)).alias("at"), F.lit(n).alias("n"), F.slice(w, i * (n // 4) + 1, n).alias("w")))
            out.append(F.when(F.size(w) > (WINDOWS[k - 1] if k else 0), cut).otherwise(F.slice(cut, 1, 0)))
        return F.filter(F.concat(*out), lambda x: enough(x["w"]))

    def best(found: Column, first: Column, last: Column, lines: Column) -> Column:
        """Of a paragraph's windows that stand, the best of each family that no line of it gave."""
        own = F.transform(F.filter(lines, lambda x: x["paragraph"].between(first, last)), lambda x: x["family"])
        rank = lambda x: F.struct(x["j"]["overlap"], x["j"]["probability"])
        beaten = lambda x: F.exists(found, lambda y: (y["j"]["family"] != x["j"]["family"]) & (y["at"] < x["at"] + x["n"]) & (x["at"] < y["at"] + y["n"]) & (rank(y) > rank(x)))
        left = F.filter(found, lambda x: ~beaten(x) & ~F.array_contains(own, x["j"]["family"]))
        kinds = F.array_distinct(F.transform(left, lambda x: x["j"]["family"]))
        top = lambda f: F.array_max(F.transform(F.filter(left, lambda x: x["j"]["family"] == f), lambda x: F.struct(x["j"]["overlap"].alias("o"), x["j"]["probability"].alias("p"))))
        return F.transform(kinds, lambda f: once(top(f), lambda t: F.struct(first.alias("paragraph"), f.alias("family"), t["p"].alias("probability"), t["o"].alias("overlap"))))

    def scored(p: Column) -> Column:
        return once(F.regexp_extract_all(F.lower(p), F.lit(WORD), F.lit(0)), weighed)

    def judged(i: Column, s: Column) -> Column:
        z, w = s["z"], F.array_distinct(s["w"])
        top = F.array_max(z)
        prob = 1 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        k = F.array_position(z, top).cast("int")
        overlap = F.lit(0.0)
        for f, templates in enumerate(model.templates):
            if templates:
                best = [F.size(F.array_intersect(w, F.lit(list(t)))) / F.lit(float(len(t))) for t in templates]
                overlap = F.when(k == f + 1, F.greatest(*best)).otherwise(overlap) if len(best) > 1 else F.when(k == f + 1, best[0]).otherwise(overlap)
        return F.struct(i.alias("paragraph"), F.element_at(F.lit(list(model.families)), k).alias("family"), prob.alias("probability"), overlap.alias("overlap"))

    def holds(x: Column) -> Column:
        return (x["family"] != UNKNOWN) & (x["probability"] >= least) & (x["overlap"] >= LEAST_OVERLAP)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: has_anchor(x["p"]))
    d = d.select("doc_id", F.when(has_anchor(F.col("text")), lines).alias("lines"), F.when(marked(F.col("text")), F.split("text", "\n")).alias("all"))
    d = d.select("doc_id", "all", F.transform("lines", lambda x: F.struct(x["i"].alias("i"), scored(x["p"]).alias("s"))).alias("lines"), F.transform("all", lambda p: p.rlike(r"[\p{L}\p{N}]")).alias("live"))
    at = F.sequence(F.lit(1), F.size("live"))
    live = lambda i: F.when((i < 1) | (i > F.size("live")), F.lit(False)).otherwise(F.element_at("live", i))
    first, last = F.filter(at, lambda i: live(i) & ~live(i - 1)), F.filter(at, lambda i: live(i) & ~live(i + 1))
    paras = F.zip_with(first, last, lambda a, b: F.struct((a - 1).alias("first"), (b - 1).alias("last"), F.array_join(F.slice("all", a, b - a + 1), " ").alias("p")))
    d = d.select("doc_id", F.transform("lines", lambda x: judged(x["i"], x["s"])).alias("found"), F.when(F.size("live") > 0, paras).alias("paras"))
    kind = d.schema["found"].dataType
    d = d.select("doc_id", F.coalesce(F.filter("found", holds), F.array().cast(kind)).alias("found"), F.filter("paras", lambda x: marked(x["p"])).alias("paras"))
    d = d.select("doc_id", "found", F.transform("paras", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), once(F.regexp_extract_all(F.lower(x["p"]), F.lit(WORD), F.lit(0)), lambda w: F.when(enough(w), windows(w))).alias("w"))).alias("paras"))
    d = d.select("doc_id", "found", F.filter("paras", lambda x: F.coalesce(F.size(x["w"]), F.lit(0)) > 0).alias("paras"))
    d = d.select("doc_id", "found", F.transform("paras", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), F.transform(x["w"], lambda v: F.struct(v["at"].alias("at"), v["n"].alias("n"), once(weighed(v["w"]), lambda z: judged(x["first"], z)).alias("j"))).alias("w"))).alias("paras"))
    better = lambda x, v: holds(v["j"]) & (v["j"]["family"] != x["family"]) & (v["j"]["overlap"] > x["overlap"])
    part = lambda x: F.exists("paras", lambda p: (p["first"] < p["last"]) & x["paragraph"].between(p["first"], p["last"]) & F.exists(p["w"], lambda v: better(x, v)))
    d = d.select("doc_id", F.filter("found", lambda x: (x["overlap"] >= CERTAIN) | ~F.coalesce(part(x), F.lit(False))).alias("found"), "paras")
    further = F.transform("paras", lambda x: once(F.filter(x["w"], lambda v: holds(v["j"])), lambda w: best(w, x["first"], x["last"], F.col("found"))))
    d = d.select("doc_id", "found", F.coalesce(F.flatten(further), F.array().cast(kind)).alias("further"))
    d = d.select("doc_id", F.sort_array(F.concat("found", "further")).alias("notices"))
    return d.select("doc_id", F.size("notices").alias("n_notices"), F.sort_array(F.array_distinct(F.transform("notices", lambda x: x["family"]))).alias("families"), "notices")
