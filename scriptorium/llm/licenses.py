"""Licence scans with a trained paragraph classifier.

A paragraph is a run of lines with words (comment marks are none); as notices stand
among other lines, or wrapped over several, its passages are scored: single lines
first, then ever more consecutive lines, up to twice the words of the longest
template, of which none is in a passage found before. A logistic regression for each
licence family over sparse unigrams and bigrams of words is fitted on the driver:
positives are notices spelled from templates, whole and with words dropped or changed
by a fixed rule; negatives are other families' notices, near misses, and at most
`sample` lines of the corpus, some of them with terms of licences in what no template
confirms. The sample is the only bounded thing here; every line of every text is scored.

Every fifth spelling, near miss and line is held out, and fits each family's scores to
probabilities (Platt's method). The unknown class is calibrated with them: the least
probability that counts for a family is above that of every held-out case that isn't
of the family, by a quarter of the way (in log odds) to the least held-out case that is,
if that is above. A prediction then is compared with its family's
templates, and stands only if enough of a template's words occur in order, within a
stretch that is hardly longer; it goes on over lines of which half the words or more
continue a template of the family.

A word or pair that no template has carries no weight, so a passage without
any of them is unknown, by the intercept, without further work.

Defined results: a null or empty text has no paragraphs; spans are code points, from
the beginning of a passage's first line to the end of its last; of equally long
passages, the first counts; repeated rows each get their row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown"
# Notices of licence families; | parts are alternatives.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL": ("This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal", "Released under CC0 1.0."),
    "Proprietary": ("All rights reserved.", "Copyright 2020 Example. All rights reserved.", "This software is proprietary and confidential. Unauthorized copying is strictly prohibited."),
}
# Paragraphs about licences that are none.
NEAR_MISSES = (
    "The driver showed a license at the gate and was let in.",
    "You need a fishing license, version of the form attached, to use this lake.",
    "The work is under way and free of charge to any person.",
    "The public was granted permission to use the general entrance.",
    "The museum is free, open to the general public and subject to conditions.",
    "Version 2.0 of the program was released in May.",
    "All rights of way were reserved for the library.",
    "Use the software and the source of the data with care.",
)
_TERM = re.compile(r"licen[sc]|spdx|copyright|rights|redistribut|proprietary|\bcc\b|\bcc0\b|permission", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Words of a that occur in b in the same order, at most. Time: len(a) * len(b)."""
    row = [0] * (len(a) + 1)
    where: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        where.setdefault(w, []).append(i)
    for w in b:
        for i in reversed(where.get(w, ())):
            best = max(row[: i + 1])
            if best + 1 > row[i + 1]:
                row[i + 1] = best + 1
    return max(row)


def shared(template: list[str], words: list[str]) -> int:
    """Words of a template that occur in order, within a stretch of words that is hardly longer than it."""
    own, width, best = set(template), len(template) + 1 + len(template) // 4, 0
    for i, w in enumerate(words):
        if w in own and best < len(template):
            best = max(best, common_subsequence(template, words[i : i + width]))
    return best


@dataclass
class Model:
    """Weights of the n-grams for each family and intercepts, what turns scores to
    probabilities (scale and shift), and least probabilities."""

    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    intercepts: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    least: np.ndarray
    templates: dict[str, list[list[str]]] = field(default_factory=dict)
    alike: float = 0.8

    def __post_init__(self) -> None:
        self.words = frozenset(w for g in self.vocabulary for w in g.split())
        # What a word adds to any family at most, alone and as the first of a pair.
        best = dict.fromkeys(self.words, 0.0)
        for g, i in self.vocabulary.items():
            best[g.split()[0]] += max(0.0, float(self.weights[:, i].max()))
        self.best = best
        self.need = float(np.min((np.log(self.least / (1 - self.least)) - self.shift) / self.scale - self.intercepts))
        self.width = 2 * max((len(t) for ts in self.templates.values() for t in ts), default=1)

    def scores(self, words: list[str]) -> np.ndarray:
        at = [self.vocabulary[g] for g in dict.fromkeys(grams(words)) if g in self.vocabulary]
        return self.intercepts + (self.weights[:, at].sum(axis=1) if at else 0.0)

    def probabilities(self, words: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.scores(words) + self.shift)))

    def predict(self, words: list[str]) -> tuple[str, float]:
        """(family or UNKNOWN, probability), before comparison with templates."""
        p = self.probabilities(words)
        over = np.where(p >= self.least, p, -1.0)
        k = int(over.argmax())
        return (self.families[k], float(p[k])) if over[k] >= 0 else (UNKNOWN, float(1 - p.max()))

    def confirmed(self, family: str, words: list[str]) -> bool:
        """Whether the words hold enough of a template of family."""
        return any(shared(t, words) >= self.alike * len(t) for t in self.templates[family])

    def goes_on(self, family: str, words: list[str], line: list[str], before: bool = False) -> bool:
        """Whether half of a line's words or more are those of a template that words hold, continued."""
        whole = [*line, *words] if before else [*words, *line]
        return any(2 * (shared(t, whole) - shared(t, words)) >= len(line) for t in self.templates[family])

    def passages(self, lines: list[list[str]]) -> list[tuple[int, int, str, float]]:
        """(first, last, family, probability) of the lines, the words of each, of one paragraph."""
        known, best, n = self.words, self.best, len(lines)
        gain, length = [0.0], [0]  # up to each line; what lines can give at most, and their words
        for words in lines:
            gain.append(gain[-1] + sum(map(best.__getitem__, known.intersection(words))))
            length.append(length[-1] + len(words))
        out: list[tuple[int, int, str, float]] = []
        free = [True] * n
        for size in range(1, n + 1):
            fits = False
            for i in range(n - size + 1):
                j = i + size
                if size > 1 and length[j] - length[i] > self.width:
                    continue
                fits = True
                # A passage whose words can't reach any family's least is unknown.
                if gain[j] - gain[i] < self.need or not all(free[i:j]):
                    continue
                words = [w for x in lines[i:j] for w in x]
                if sum(map(best.__getitem__, known.intersection(words))) < self.need:
                    continue
                family, p = self.predict(words)
                if family == UNKNOWN or not self.confirmed(family, words):
                    continue
                while j < n and free[j] and length[j + 1] - length[i] <= self.width and self.goes_on(family, words, lines[j]):
                    words, j = words + lines[j], j + 1
                while i and free[i - 1] and length[j] - length[i - 1] <= self.width and self.goes_on(family, words, lines[i - 1], before=True):
                    words, i = lines[i - 1] + words, i - 1
                free[i:j] = [False] * (j - i)
                out.append((i, j - 1, family, p))
            if not fits or gain[n] < self.need:
                break
        return sorted(out)

    def scan(self, text: str | None) -> list[dict]:
        """The licence passages of a text."""
        out, at = [], 0
        places: list[tuple[int, int]] = []
        lines: list[list[str]] = []

        def finish() -> None:
            for i, j, family, p in self.passages(lines):
                out.append({"family": family, "start": places[i][0], "end": places[j][1], "probability": p})
            places.clear()
            lines.clear()

        for line in (text or "").split("\n"):
            words = tokens(line) if line else []
            if words:
                places.append((at, at + len(line)))
                lines.append(words)
            elif lines:
                finish()
            at += len(line) + 1
        if lines:
            finish()
        return out


def spelled(template: str) -> list[list[str]]:
    """A template's words, and as people change them: with one word missing,
    with one word another, within other words."""
    words = tokens(template)
    out = [words]
    for i in range(len(words)):
        if len(words) >= 6:
            out.append(words[:i] + words[i + 1 :])
            out.append(words[:i] + ["xx"] + words[i + 1 :])
    out += [["xx", "yy", *words], [*words, "yy", "xx"], ["copyright", "2020", "xx", *words]]
    return out


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift that turn scores z to probabilities of y, by Newton's method on Platt's targets."""
    good, bad = float(y.sum()), float((1 - y).sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w, d = np.maximum(p * (1 - p), 1e-9), p - target
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()]))
        step = np.clip(step, -1, 1)
        a, b = max(a - step[0], 0.05), b - step[1]
    return float(a), float(b)


def cases(paragraphs: list[list[str]]) -> tuple[list[list[str]], list[int], list[bool]]:
    """Words, family (its place among the sorted ones, -1 for none), and whether held out."""
    rows: list[tuple[list[str], int, bool]] = []
    all_ = {name: [tokens(t) for t in TEMPLATES[name]] for name in sorted(TEMPLATES)}
    share = lambda t, words: shared(t, words) / len(t)
    for k, name in enumerate(all_):
        for t in TEMPLATES[name]:
            # Without the word that tells it from another family, a spelling is as much one of that.
            others = [x for other, ts in all_.items() if other != name for x in ts]
            good = [words for words in spelled(t) if share(tokens(t), words) > max(share(x, words) for x in others)]
            rows += [(words, k, i % 5 == 4) for i, words in enumerate(good)]
    for negatives_ in ([tokens(x) for x in NEAR_MISSES], paragraphs):
        rows += [(words, -1, i % 5 == 0) for i, words in enumerate(negatives_)]
    words, labels, held = zip(*rows, strict=True)
    return list(words), list(labels), list(held)


def fit(paragraphs: list[list[str]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """The model for TEMPLATES, with paragraphs (words each) as negatives."""
    families = sorted(TEMPLATES)
    vocabulary: dict[str, int] = {}
    for name in families:
        for t in TEMPLATES[name]:
            for g in grams(tokens(t)):
                vocabulary.setdefault(g, len(vocabulary))
    everything, labels, held = cases(paragraphs)
    rows = [w for w, h in zip(everything, held, strict=True) if not h]
    label = np.array([k for k, h in zip(labels, held, strict=True) if not h])
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, words in enumerate(rows):
        x[i, [vocabulary[g] for g in set(grams(words)) if g in vocabulary]] = 1
    y = (label[:, None] == np.arange(len(families))).astype(np.float32)
    counts = Counter(label.tolist())
    share = np.array([1 / counts[i] for i in label.tolist()], dtype=np.float32)[:, None] / (len(families) + 1)
    share = np.where(y == 1, share * 4, share)  # one family against all others
    weights = np.zeros((len(vocabulary), len(families)), dtype=np.float32)
    intercepts = np.full(len(families), -1.0, dtype=np.float32)
    square = np.full_like(weights, 1e-6)
    square_i = np.full_like(intercepts, 1e-6)
    for _ in range(rounds):
        error = share * (1 / (1 + np.exp(-(x @ weights + intercepts))) - y)
        g, gi = x.T @ error + decay * weights, error.sum(axis=0)
        square += g * g
        square_i += gi * gi
        weights -= rate * g / np.sqrt(square)
        intercepts -= rate * gi / np.sqrt(square_i)
    # An empty paragraph is unknown, whatever was learned.
    one, half = np.ones(len(families)), np.full(len(families), 0.5)
    model = Model(families, vocabulary, weights.T.astype(np.float64), np.minimum(intercepts, -1.0).astype(np.float64), one, 0 * one, half, {f: [tokens(t) for t in TEMPLATES[f]] for f in families})
    out = [(w, k) for w, k, h in zip(everything, labels, held, strict=True) if h]
    z = np.array([model.scores(w) for w, _ in out])
    own = np.array([k for _, k in out])[:, None] == np.arange(len(families))
    for k in range(len(families)):
        model.scale[k], model.shift[k] = platt(z[:, k], own[:, k].astype(float))
    q = model.scale * z + model.shift
    worst, good = np.where(own, -np.inf, q).max(axis=0), np.where(own, q, np.inf).min(axis=0)
    model.least = 1 / (1 + np.exp(-(worst + np.maximum((good - worst) / 4, 1e-3))))
    model.__post_init__()
    return model


def negatives(docs: DataFrame, text: str = "text", sample: int = 2000) -> list[list[str]]:
    """At most `sample` lines of ordinary length, first by a hash: up to a quarter of them
    with terms of licences, where no template confirms a licence, the others without.

    They come from about `sample` documents, chosen by a hash of the whole row,
    so that what tasks send to the driver doesn't grow with the table."""
    n = docs.count()
    if n > sample:
        docs = docs.filter(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < F.lit((1 << 30) * sample // n + 1))
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).filter(F.length("line").between(20, 2000))
    term = F.col("line").rlike(f"(?i){_TERM.pattern}")
    first = lambda some, most: [tokens(r[0]) for r in some.orderBy(F.xxhash64("line"), "line").limit(most).collect()]
    templates = [tokens(t) for ts in TEMPLATES.values() for t in ts]
    with_terms = [w for w in first(lines.filter(term).distinct(), sample // 4) if not any(shared(t, w) >= 0.8 * len(t) for t in templates)]
    return first(lines.filter(~term), sample - sample // 4) + with_terms


_PARAGRAPHS = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = 2000) -> DataFrame:
    """(id, paragraphs): one row per document; paragraphs (family, start, end, probability) in order."""
    docs = docs.select(id_col, text)
    sent = docs.sparkSession.sparkContext.broadcast(fit(negatives(docs, text, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = sent.value.scan
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scan(x) for x in b.column(1).to_pylist()], _PARAGRAPHS)], names=[id_col, "paragraphs"])

    found = T.ArrayType(T.StructType.fromDDL("family string, start int, end int, probability double"))
    return docs.mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("paragraphs", found)]))
