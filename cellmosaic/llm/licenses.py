"""Licence scan by a trained paragraph classifier.

Paragraphs are the lines of a text, cut after sentences. Their features are word n-grams
(1 to 3), hashed to ``BUCKETS``, as counts over the root of their number. A multinomial
logistic regression tells licence families from the class "none", which is learned from
paragraphs of the corpus itself. A logistic curve, fitted on rows that the regression has
not seen, turns the odds against "none" into a probability. What is at least 0.5 is a
licence paragraph: of all families that with the best fitting template, the likeliest
of equals, is confirmed if enough of the template's word pairs stand in the paragraph,
otherwise the paragraph counts as unknown.

Notices are often wrapped over several lines, with or without comment signs. Lines that
neither a sentence end nor a line without words parts are therefore also searched
together: wherever enough of a template's word pairs stand across a line end, these words
are a licence paragraph too if their probability is at least 0.5. Of overlapping
paragraphs that with the best fitting template is kept.

The fit takes the templates with variations of them (dropped words, words before) and
paragraphs without a licence word from about ``NONE_DOCS`` documents, at most about
``NONE_ROWS`` of them, chosen by hashes: bounds that hold whatever the input.

Null and empty texts have no paragraph. Rows repeated are each scanned. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.quality import logistic_curve
from cellmosaic.session import durable

BUCKETS = 1 << 15
NONE_DOCS = 2_000
NONE_ROWS = 6_000
LEAST_WORDS = 2  # of a licence paragraph
LEAST_SHARE = 0.6  # of a template's word pairs
VARIATIONS = 8
CACHE_TOKENS = 200_000

# fixed values: notices as projects commonly write them, by family
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license, see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL v2 or later.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You can redistribute it under the terms of the GNU Affero General Public License.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted.",
        "SPDX-License-Identifier: ISC",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under the Unlicense.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
# fixed values: sentences with licence words that grant nothing
PLAIN = (
    "He got his driving license last year.", "The licence fee rises again in spring.",
    "A fishing license is needed at the lake.", "Copyright law is taught in the second term.",
    "Her rights as a tenant were respected.", "The general public was not admitted.",
    "The foundation published a report on software.", "Version 2.0 of the plan was rejected.",
    "The plate showed an old license number.", "All seats are reserved for members.",
)
FAMILIES = ("none", *TEMPLATES)

_PIECE = re.compile(r"(?P<word>[^\W_]+(?:\.\d+)*)|(?P<end>\n+|[.!?]+(?=\s|$))")
_STOP = re.compile(r"[.!?]\s")
_CUE = r"(?i)licen[sc]|copyright|spdx|rights|gnu|creative commons|public domain|permission|redistribut"


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        self[token] = i = zlib.crc32(token.encode("utf-8", "replace"))
        return i


def pieces(text: str) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
    """Words in lower case, the number of words before each paragraph's end, paragraph spans."""
    words, ends, spans, first, last = [], [], [], None, 0
    for m in _PIECE.finditer(text):
        if m.lastgroup == "word":
            words.append(m.group().lower())
            first, last = m.start() if first is None else first, m.end()
        elif first is not None:
            ends.append(len(words))
            spans.append((first, last))
            first = None
    if first is not None:
        ends.append(len(words))
        spans.append((first, last))
    return words, np.array(ends, np.int64), spans


def gram_rows(words: list[str], ends: np.ndarray, known: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and the paragraph of each; n-grams never cross paragraphs."""
    if len(known) > CACHE_TOKENS:
        known.clear()
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    owner = np.searchsorted(ends, np.arange(len(words)), "right")
    grams, owners, chain = [ids * 0x9E3779B1], [owner], ids
    for n in (1, 2):
        if len(ids) <= n:
            break
        chain = (chain[:-1] * 0x5851F42D + ids[n:] * 0x85EBCA77 + n) & 0xFFFFFFFFFF
        inside = owner[n:] == owner[:-n]
        grams.append(chain[inside] * 0xC2B2AE3D)
        owners.append(owner[:-n][inside])
    hashed = np.concatenate(grams) & 0xFFFFFFFFFFFF
    owners = np.concatenate(owners)
    by = np.argsort(owners, kind="stable")
    return ((hashed ^ (hashed >> 19)) % BUCKETS)[by], owners[by]


def logits(words, ends, known, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """paragraphs x families."""
    grams, owner = gram_rows(words, ends, known)
    starts = np.searchsorted(owner, np.arange(len(ends)))
    sums = np.add.reduceat(weights[grams], starts, axis=0)
    counts = np.diff(np.append(starts, len(grams)))
    return sums / np.sqrt(counts)[:, None] + bias


def pairs(words: list[str]) -> set:
    return set(zip(words, words[1:])) if len(words) > 1 else {(w, "") for w in words}


def template_pairs() -> dict[str, list[set]]:
    out = {}
    for family, notices in TEMPLATES.items():
        out[family] = []
        for notice in notices:
            words, ends, _ = pieces(notice)
            out[family] += [pairs(words[a:b]) for a, b in zip([0, *ends[:-1]], ends) if b - a > 2]
    return out


def likeness(words: list[str], templates: list[set]) -> float:
    """Largest share of a template's word pairs that the words have."""
    own = pairs(words)
    return max((len(own & t) / len(t) for t in templates), default=0.0)


class _Wrapped:
    """Notices across line ends, by the word pairs of all templates."""

    def __init__(self, templates: dict[str, list[set]]):
        self.templates = [(family, t) for family, notices in templates.items() for t in notices]
        self.of_pair: dict[tuple, list[int]] = {}
        for k, (_, t) in enumerate(self.templates):
            for pair in t:
                self.of_pair.setdefault(pair, []).append(k)

    @staticmethod
    def runs(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Paragraphs first to last of each run of at least two lines that one line end each parts."""
        out, first = [], 0
        for i in range(1, len(spans) + 1):
            if i < len(spans):
                gap = text[spans[i - 1][1]:spans[i][0]]
                if gap.count("\n") == 1 and not _STOP.search(gap):
                    continue
            if i - first > 1:
                out.append((first, i))
            first = i
        return out

    def find(self, words: list[str], cuts: list[int]) -> list[tuple[float, str, int, int]]:
        """(likeness, family, first word, end) of parts that cross one of the line ends ``cuts``."""
        hits: dict[int, list] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            for k in self.of_pair.get(pair, ()):
                hits.setdefault(k, []).append((i, pair))
        out = []
        for k, at in hits.items():
            family, template = self.templates[k]
            if len({pair for _, pair in at}) < LEAST_SHARE * len(template):
                continue
            inside, left, shortest = {}, 0, []
            for right, (_, pair) in enumerate(at):
                inside[pair] = inside.get(pair, 0) + 1
                while len(inside) >= LEAST_SHARE * len(template):  # the last drop ends the shortest part
                    gone = at[left][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                        if len(inside) < LEAST_SHARE * len(template):
                            shortest.append((at[right][0] - at[left][0], left, right))
                    left += 1
            taken = np.zeros(len(at), bool)
            for _, a, b in sorted(shortest):
                if taken[a:b + 1].any():
                    continue
                own = {pair for _, pair in at[a:b + 1]}
                # on to both sides while more of the template follows closely
                while b + 1 < len(at) and not taken[b + 1] and at[b + 1][1] not in own and at[b + 1][0] - at[b][0] <= len(template):
                    b += 1
                    own.add(at[b][1])
                while a > 0 and not taken[a - 1] and at[a - 1][1] not in own and at[a][0] - at[a - 1][0] <= len(template):
                    a -= 1
                    own.add(at[a][1])
                taken[a:b + 1] = True
                first, end = at[a][0], at[b][0] + 2
                if any(first < cut < end for cut in cuts):
                    out.append((len(own) / len(template), family, first, end))
        return out


def training_rows() -> list[tuple[int, str]]:
    """(class, paragraph) from the templates, their variations and the plain sentences."""
    rng = np.random.default_rng(3)
    before = ("This software is", "Copyright 2021 The Authors", "The code below is", "Note that all content is")
    rows = []
    for k, family in enumerate(FAMILIES):
        for notice in TEMPLATES.get(family, PLAIN):
            words, ends, _ = pieces(notice)
            for a, b in zip([0, *ends[:-1]], ends):
                part = words[a:b]
                rows += [(k, " ".join(part))] * 3
                rows += [(k, f"{p.lower()} {' '.join(part)}") for p in before]
                for _ in range(VARIATIONS):
                    kept = [w for w in part if rng.random() > 0.12]
                    rows.append((k, " ".join(kept or part)))
    return rows


def _vector(text: str, known: _Tokens) -> SparseVector:
    words, ends, _ = pieces(text)
    grams = gram_rows(words, np.array([len(words)]), known)[0] if words else np.empty(0, np.int64)
    at, n = np.unique(grams, return_counts=True)
    return SparseVector(BUCKETS, at.tolist(), (n / math.sqrt(max(1, len(grams)))).tolist())


def _paragraph_rows(batches):
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            words, ends, _ = pieces(text or "")
            out += [" ".join(words[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["paragraph"])


def fit(docs: DataFrame):
    """(weights, bias, slope, offset) of the classifier."""
    spark = docs.sparkSession
    total = docs.count()
    spot = F.pmod(F.xxhash64(F.lit("none"), "doc_id"), F.lit(1 << 20))
    some = docs.select("doc_id", "text").filter(spot < F.lit(int((1 << 20) * min(1.0, NONE_DOCS / max(1, total))) + 1))
    found = durable(some.select("text").mapInArrow(_paragraph_rows, "paragraph string").filter(
        ~F.col("paragraph").rlike(_CUE)).distinct())
    n = found.count()
    spot = F.pmod(F.xxhash64(F.lit("row"), "paragraph"), F.lit(1 << 20))
    none = found.filter(spot < F.lit(int((1 << 20) * min(1.0, NONE_ROWS / max(1, n))) + 1))
    rows = [*training_rows(), *((0, r["paragraph"]) for r in none.orderBy("paragraph").collect())]
    known = _Tokens()
    table = [(float(k), zlib.crc32(f"{k}:{t}".encode()) % 5, _vector(t, known)) for k, t in rows]
    frame = durable(spark.createDataFrame(table, ["label", "fold", "features"]).repartition(2, "fold"))
    model = LogisticRegression(maxIter=40, regParam=2e-4, family="multinomial", standardization=False).fit(
        frame.filter("fold > 0"))
    weights = model.coefficientMatrix.toArray().T.astype(np.float32)
    bias = model.interceptVector.toArray().astype(np.float32)
    rest = [(k, t) for k, t in rows if zlib.crc32(f"{k}:{t}".encode()) % 5 == 0]
    margin = np.array([_odds(logits(*pieces(t)[:2], known, weights, bias))[0] for _, t in rest if t])
    slope, offset = logistic_curve(margin, np.array([float(k > 0) for k, t in rest if t]))
    return weights, bias, slope, offset


def _odds(values: np.ndarray) -> np.ndarray:
    """Log-odds of any family against none."""
    top = values[:, 1:].max(axis=1)
    return top + np.log(np.exp(values[:, 1:] - top[:, None]).sum(axis=1)) - values[:, 0]


def _scan(model):
    def run(batches):
        weights, bias, slope, offset = model.value
        known, templates = _Tokens(), template_pairs()
        wrapped = _Wrapped(templates)

        def chances(words, ends):
            values = logits(words, ends, known, weights, bias)
            return values, 1 / (1 + np.exp(-np.clip(slope * _odds(values) + offset, -50, 50)))

        def across(text, words, ends, spans):
            """Rows of the parts across line ends that are likely enough."""
            rows = []
            for first, last in wrapped.runs(text, spans):
                start = int(ends[first - 1]) if first else 0
                part = words[start:ends[last - 1]]
                for like, family, a, b in wrapped.find(part, [int(e) - start for e in ends[first:last - 1]]):
                    chance = float(chances(part[a:b], np.array([b - a]))[1][0])
                    if chance >= 0.5:
                        at = [m.span() for m in _PIECE.finditer(text, spans[first][0], spans[last - 1][1]) if m.lastgroup == "word"]
                        rows.append({"family": family, "start": at[a][0], "end": at[b - 1][1],
                                     "probability": chance, "likeness": like})
            return rows

        kind = pa.list_(pa.struct([
            ("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()),
            ("likeness", pa.float64())]))
        for batch in batches:
            counts, best, found = [], [], []
            for text in batch.column("text").to_pylist():
                words, ends, spans = pieces(text or "")
                counts.append(len(ends))
                if not len(ends):
                    best.append(0.0)
                    found.append([])
                    continue
                values, chance = chances(words, ends)
                best.append(float(chance.max()))
                rows = []
                wide = np.diff(ends, prepend=0) >= LEAST_WORDS
                for i in np.flatnonzero((chance >= 0.5) & wide):
                    part = words[ends[i - 1] if i else 0:ends[i]]
                    # the likeliest first; near relatives differ in a word that the template shows
                    rivals = [FAMILIES[1 + j] for j in np.argsort(-values[i, 1:], kind="stable")]
                    like, family = max(((likeness(part, templates[f]), f) for f in rivals), key=lambda x: x[0])
                    rows.append({
                        "family": family if like >= LEAST_SHARE else "unknown", "start": spans[i][0],
                        "end": spans[i][1], "probability": float(chance[i]), "likeness": like})
                joined = across(text, words, ends, spans) if "\n" in text else []
                if joined:
                    best[-1] = max(best[-1], *(x["probability"] for x in joined))
                    kept = []
                    for x in sorted([*rows, *joined], key=lambda x: (-x["likeness"], x["start"] - x["end"])):
                        if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in kept):
                            kept.append(x)
                    rows = sorted(kept, key=lambda x: x["start"])
                found.append(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(best, pa.float64()),
                 pa.array(found, kind)], ["doc_id", "n_paragraphs", "score", "found"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_paragraphs, score (highest licence probability), found (paragraphs)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _scan(model),
        "doc_id long, n_paragraphs long, score double, found array<struct<family:string,start:bigint,end:bigint,"
        "probability:double,likeness:double>>")
