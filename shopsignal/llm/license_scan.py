"""License scans: a trained paragraph classifier whose predictions a template comparison confirms.

The classifier is a multinomial logistic regression over sparse word n-grams (Spark ML's hashing
and solver). Its training paragraphs are made from the templates, with words dropped, replaced and
added, and from a bounded sample of the corpus' own paragraphs as the unknown class; a share left
out calibrates the probability below which a prediction is unknown. The fitted weights are applied
to all paragraphs in tasks; words outside the templates' vocabulary weigh nothing. A predicted
family stands if the paragraph holds enough of one of its templates' word pairs. A notice wrapped
over lines, or within a longer line, is found by its template's word pairs in a window of the whole
text's words, which the classifier then judges. Titles and SPDX tags are compared as a whole.
"""
from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.llm.common import append_columns, fresh_names, hash_sample

# Short notices and the telling sentences of longer ones of common licence families.
_GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by "
        "the Free Software Foundation, either version {2} of the License, or (at your option) any later version.",
        "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License",
        "You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see https://www.gnu.org/licenses/")
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.",
             "Licensed under the GNU Affero General Public License.", *(t.format("program", "Affero ", "3") for t in _GNU)],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright.",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
            *(t.format("program", "", "3") for t in _GNU)],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "Licensed under the GNU Lesser General Public License.", *(t.format("library", "Lesser ", "2.1") for t in _GNU)],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software"],
    "mpl": ["This source code is subject to the terms of the Mozilla Public License, version 2.0.",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
            "You can obtain one at https://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "Proprietary and confidential. All rights reserved.",
                    "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: what a title line holds beside the words of FILL
TITLES = {
    "agpl": ["gnu affero general public", "affero general public", "gnu agpl", "agpl", "agplv3"],
    "apache": ["apache", "apache software"],
    "bsd": ["bsd", "bsd clause", "clause bsd", "new bsd", "modified bsd", "simplified bsd", "bsd clause new revised", "bsd clause simplified"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike"],
    "cc0": ["cc0", "creative commons cc0"],
    "gpl": ["gnu general public", "gnu gpl", "gpl", "gplv2", "gplv3"],
    "lgpl": ["gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl", "lgplv2", "lgplv3"],
    "mit": ["mit", "mit mit", "expat"],
    "mpl": ["mozilla public", "mpl"],
}
FILL = frozenset(b"the a license licence licensed under version v v2 v3 or later only international universal unported generic january february "
                 b"june november".split())
TITLE_WORDS = 14                 # a title line has no more words
_TITLE = {tuple(t.encode().split()): k for k, ts in TITLES.items() for t in ts}
_NAMES = frozenset(w for t in _TITLE for w in t)
SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
SPDX_ID = re.compile(rb"(?<![\w.-])(?:(AGPL|LGPL|GPL|MPL|APACHE|BSD|MIT|CC0|CC-BY-NC|CC-BY-SA)(?![\w.])|(CC-BY)(?=-\d)|(0BSD)(?![\w.]))", re.IGNORECASE)
UNKNOWN = "unknown"
#: lower-case ASCII letters and digits, and bytes of other characters; anything else separates words
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FEATURES = 1 << 13
GRAMS = 3
CONFIRM = 0.6                    # share of a template's word pairs that the paragraph must hold
SPAN = 2                         # a window has at most so many times its template's words
SAMPLE_PARAGRAPHS = 4000         # corpus paragraphs learned as unknown
VARIANTS = 60                    # paragraphs made from each template
FALSE_RATE = 0.001               # unknown paragraphs that calibration lets through


def words_of(paragraph: bytes) -> list[bytes]:
    return paragraph.translate(FOLD).split()


def features(words: list[bytes], vocabulary: set[bytes]) -> list[int]:
    """Hashed 1- to GRAMS-grams made only of vocabulary words."""
    out = []
    for n in range(1, GRAMS + 1):
        for i in range(len(words) - n + 1):
            gram = words[i:i + n]
            if all(w in vocabulary for w in gram):
                out.append(zlib.crc32(b" ".join(gram)) % FEATURES)
    return out


def pairs(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {*zip(words, words[1:])} or {tuple(words)}


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray              # families x FEATURES, the last row is UNKNOWN
    bias: np.ndarray
    least: float                     # probability below which a prediction is unknown
    templates: dict[str, list[list[bytes]]] = field(default_factory=dict)
    frequent: frozenset[bytes] = frozenset()

    def __post_init__(self):
        """``keys``: without one of them no paragraph can hold enough of any template's word pairs."""
        self.vocabulary = {w for ts in self.templates.values() for t in ts for w in t}
        self.keys = self.vocabulary - self.frequent
        for t in (t for ts in self.templates.values() for t in ts):
            if sum(not self.keys & set(p) for p in pairs(t)) >= CONFIRM * len(pairs(t)):
                self.keys |= set(t)
        self.listed = [(k, len(t), len(pairs(t))) for k, ts in self.templates.items() for t in ts]
        self.owners: dict[tuple[bytes, ...], list[int]] = {}
        for n, t in enumerate(t for ts in self.templates.values() for t in ts):
            for p in pairs(t):
                self.owners.setdefault(p, []).append(n)

    def predict(self, words: list[bytes]) -> tuple[str, float]:
        """(family or UNKNOWN, probability of the likeliest family)."""
        z = self.bias + self.weights[:, np.array(sorted(set(features(words, self.vocabulary))), np.int64)].sum(1)
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p[:-1].argmax())
        return (self.families[k] if p[k] >= self.least and p[k] > p[-1] else UNKNOWN), float(p[k])

    def confirm(self, family: str, words: list[bytes]) -> float:
        """The largest share of a template's word pairs that the paragraph holds."""
        held = pairs(words)
        return max(len(held & pairs(t)) / len(pairs(t)) for t in self.templates[family])

    def most(self, family: str, words: list[bytes]) -> int:
        """The most word pairs of a template that the paragraph holds."""
        return max(len(pairs(words) & pairs(t)) for t in self.templates[family])


def _variants(template: list[bytes], other: list[bytes], n: int, rng) -> list[list[bytes]]:
    """The template with up to a quarter of its words dropped or replaced and words around it."""
    out = [template]
    for _ in range(n - 1):
        body = list(template)
        for _ in range(int(rng.integers(0, max(1, len(body) // 4) + 1))):
            i = int(rng.integers(len(body)))
            if rng.random() < 0.5 and len(body) > 2:
                del body[i]
            elif other:
                body[i] = other[int(rng.integers(len(other)))]
        around = [other[int(i)] for i in rng.integers(len(other), size=int(rng.integers(0, 12)))] if other else []
        cut = int(rng.integers(len(around) + 1))
        out.append(around[:cut] + body + around[cut:])
    return out


def learn(docs: DataFrame, templates: dict[str, list[str]] | None = None, *, doc_id: str = "doc_id", text: str = "text",
          sample_paragraphs: int = SAMPLE_PARAGRAPHS, seed: int = 11) -> Model:
    """A model from the templates and at most ``sample_paragraphs`` paragraphs of ``docs``.

    The sample takes one paragraph each of the documents that are first by a hash of doc_id (of rows
    that share a doc_id, the least of their paragraphs); a
    paragraph that holds half of a template's word pairs is left out of the unknown class.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    spark = docs.sparkSession
    parsed = {k: [words_of(t.encode()) for t in ts] for k, ts in sorted((templates or TEMPLATES).items())}
    vocabulary = {w for ts in parsed.values() for t in ts for w in t}
    ids = docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id")).distinct()
    chosen = hash_sample(ids, sample_paragraphs, "id")                      # at most sample_paragraphs
    lines = F.filter(F.split(F.col(text).cast("string"), "\n"), lambda x: F.length(F.trim(x)) > 0)
    body = docs.select(F.col(doc_id).alias("id"), lines.alias("lines")).join(F.broadcast(chosen), "id").filter(F.size("lines") > 0)
    pick = (F.pmod(F.xxhash64("id"), F.size("lines")) + 1).cast("int")
    part = body.select("id", F.substring(F.element_at("lines", pick), 1, 1000).alias("p"))
    sample = sorted(r.p for r in part.groupBy("id").agg(F.min("p").alias("p")).collect())    # a row per chosen id
    rng = np.random.default_rng(seed)
    held = [pairs(t) for ts in parsed.values() for t in ts]
    unknown = []
    for p in sample:
        words = words_of(p.encode())
        if words and all(len(h & pairs(words)) < 0.5 * len(h) for h in held):
            unknown.append(words)
    common = sorted({w for ws in unknown for w in ws})[:20000]
    often = Counter(w for ws in unknown for w in set(ws))
    frequent = frozenset(w for w, n in often.items() if n > len(unknown) / 200)
    # words of the templates in other orders are unknown too
    bag = sorted(vocabulary)
    unknown += [[bag[int(i)] for i in rng.integers(len(bag), size=int(rng.integers(1, 9)))] for _ in range(300)]
    rows = [(k, v) for k, (_, ts) in enumerate(parsed.items()) for t in ts for v in _variants(t, common, VARIANTS, rng)]
    rows += [(len(parsed), w) for w in unknown]
    made = [(float(k), Vectors.sparse(FEATURES, {i: 1.0 for i in features(w, vocabulary)})) for k, w in rows]
    left_out = rng.random(len(made)) < 0.25
    train = spark.createDataFrame([r for r, o in zip(made, left_out) if not o], ["label", "features"])
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(train)
    model = Model([*parsed, UNKNOWN], fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), 0.0, parsed, frequent)
    wrong = sorted((model.predict(w)[1] for (k, w), o in zip(rows, left_out) if o and k == len(parsed)), reverse=True)
    model.least = max(0.5, wrong[int(len(wrong) * FALSE_RATE)]) if wrong else 0.5
    return model


def scan(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with what every paragraph (a line with a word) of each whole text says; the names used.

    New columns: paragraphs (long), licenses (array: the confirmed family of each licensed
    paragraph or notice over several of them, in order), lines (array of the numbers of their first
    lines, from 0), shares (array of the template shares, 1 for titles and SPDX tags). A tag that
    names several families gives each of them. Null and empty texts have no paragraphs; repeated rows get equal results; an
    empty table gives no rows; clashing columns are renamed as the dict says.
    """
    names = fresh_names(docs.columns, ("paragraphs", "licenses", "lines", "shares"))
    sent = docs.sparkSession.sparkContext.broadcast(model)   # families x FEATURES weights

    def score(texts):
        return [list(c) for c in zip(*(scan_text(t, sent.value) for t in texts))] if texts else [[], [], [], []]
    return append_columns(docs, text, [(names["paragraphs"], "bigint"), (names["licenses"], "array<string>"), (names["lines"], "array<int>"),
                                       (names["shares"], "array<double>")], score, keep), names


def title(words: list[bytes]) -> str | None:
    """The family that a whole line names as a title."""
    if len(words) > TITLE_WORDS or _NAMES.isdisjoint(words):
        return None
    rest = tuple(w for w in words if w not in FILL and not w.isdigit())
    named = len(rest) > 1 and rest[0] in (b"gnu", b"creative", b"mozilla", b"cc") or rest[:1] == (b"cc0",)
    return _TITLE.get(rest) if named or b"license" in words or b"licence" in words else None


def tagged(line: bytes) -> list[str]:
    """The families of a line's SPDX tag, in order."""
    found = SPDX.search(line)
    ids = re.sub(rb"\bWITH\s+\S+", b"", found[1], flags=re.IGNORECASE) if found else b""
    return list(dict.fromkeys((m[1] or m[2] or b"bsd").decode().lower() for m in SPDX_ID.finditer(ids)))


def windows(words: list[bytes], model: Model) -> list[tuple[int, int, int, int]]:
    """(held pairs, template number, start, end): windows of at most SPAN times a template's words
    that hold CONFIRM of its word pairs; of windows that overlap the fullest and then the shortest."""
    places: dict[int, list[int]] = {}
    for i in [i for i, p in enumerate(zip(words, words[1:])) if p in model.owners]:
        for n in model.owners[words[i], words[i + 1]]:
            places.setdefault(n, []).append(i)
    out = []
    for n, at in places.items():
        _, size, whole = model.listed[n]
        if len(at) < CONFIRM * whole:
            continue
        own, held, a = [], Counter(), 0
        for i in at:
            held[words[i], words[i + 1]] += 1
            while i + 2 - at[a] > SPAN * size or held[words[at[a]], words[at[a] + 1]] > 1:
                p = words[at[a]], words[at[a] + 1]
                held[p] -= 1
                if not held[p]:
                    del held[p]
                a += 1
            if len(held) >= CONFIRM * whole:
                new = (len(held), n, at[a], i + 2)
                if own and new[2] < own[-1][3]:
                    if (new[0], new[2] - new[3]) > (own[-1][0], own[-1][2] - own[-1][3]):
                        own[-1] = new
                else:
                    own.append(new)
        out += own
    return out


def scan_text(text: bytes | None, model: Model) -> tuple[int, list[str], list[int], list[float]]:
    words: list[bytes] = []
    ends: list[int] = []                                     # of each line, in words
    n, found = 0, []                                         # (pairs held, share, family, line, start, end)
    for i, line in enumerate((text or b"").split(b"\n")):
        own, a = words_of(line), len(words)
        words += own
        ends.append(len(words))
        if not own:
            continue
        n += 1
        tags = [k for k in tagged(line) if k in model.templates] if b"spdx" in own else []
        if tags:
            found += [(len(own), 1.0, k, i, a, len(words)) for k in tags]
        elif (family := title(own)) in model.templates:
            found.append((len(own), 1.0, family, i, a, len(words)))
        elif any(map(model.keys.__contains__, own)):         # else no template could confirm a family
            family, _ = model.predict(own)
            if family != UNKNOWN and (share := model.confirm(family, own)) >= CONFIRM:
                found.append((model.most(family, own), share, family, i, a, len(words)))
    wide = []
    for held, t, a, b in windows(words, model):
        family, size, whole = model.listed[t]
        i = bisect_right(ends, a)
        if b > ends[i] or ends[i] - (ends[i - 1] if i else 0) > SPAN * size:
            wide.append((held, held / whole, family, i, a, b))
    if wide:                                                 # the fullest of those that share words stand
        likely = [(c, True) for c in wide if model.predict(words[c[4]:c[5]])[0] == c[2]]
        ranked = sorted([(c, False) for c in found] + likely, key=lambda x: (-x[0][0], -x[0][1], x[0][4], x[0][2]))
        found, taken, whole_lines = [], bytearray(len(words)), set()
        for c, is_wide in ranked:
            if not any(taken[c[4]:c[5]]) or (not is_wide and c[3] in whole_lines):
                found.append(c)
                taken[c[4]:c[5]] = b"\1" * (c[5] - c[4])
                if not is_wide:
                    whole_lines.add(c[3])                    # a tag line may give several families
        found.sort(key=lambda c: (c[3], c[4]))
    return n, [c[2] for c in found], [c[3] for c in found], [c[1] for c in found]
