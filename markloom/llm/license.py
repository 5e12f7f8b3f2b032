"""Licence scan by a trained paragraph classifier.

Paragraphs are the lines of a text, and windows of words that cross line ends within a run of lines that aren't blank
(a line of comment marks is blank), as notices are wrapped. A window is where a template's shingles lie: at least 0.8
of them within twice the template's words. A softmax regression over sparse word n-grams (one and two words, hashed to
nothing: the vocabulary is that of the training paragraphs) tells the licence families and "unknown". It is trained on
variations of the notices below (words dropped, put in prose, cut short, other versions and holders) against general
prose and near misses, on a fixed number of paragraphs. A temperature and the smallest probability that counts as
known are calibrated on paragraphs left out of the fit. A prediction stands only if the paragraph holds a template of
the family: at least 0.8 of a template's shingles of five words (all words where a template has fewer).

n_paragraphs counts the lines with text. Each line is answered as a whole; a window counts besides its lines only where
none of them has the window's family, and its line is the first one.

Null and empty texts have no paragraphs and no licence; paragraphs without a word of the vocabulary are unknown. Of
families with the same probability the first in TEMPLATES is meant. Texts and lines of any length are read whole. Only
doc_id and text are read; rows are answered one by one, so nulls and repeats need no rule.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches, text_bytes

SHINGLE, CONTAINMENT = 5, 0.8
VARIATIONS = 30
SEED = 11
UNKNOWN = "unknown"
WORD = re.compile(rb"[0-9a-z]+")
#: What lines between the paragraphs of a comment may hold.
MARKS = b" \t\r\x0b\f#*/;%-<>!|"

#: Notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Distributed under the Apache License 2.0.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GPL version 3.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the 3-Clause BSD License.", "Released under the BSD License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0."),
    "CC0": ("Dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."),
    "Proprietary": ("All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "This software is proprietary and confidential."),
}
#: Identifiers of the families in a machine-readable tag.
TAGS = {"Apache-2.0": "Apache-2.0", "MIT": "MIT", "GPL-3.0": "GPL-3.0", "GPL-2.0": "GPL-2.0", "LGPL": "LGPL-2.1", "AGPL-3.0": "AGPL-3.0", "BSD": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "CC-BY": "CC-BY-4.0", "CC-BY-SA": "CC-BY-SA-4.0", "CC-BY-NC": "CC-BY-NC-4.0", "ISC": "ISC", "EPL-2.0": "EPL-2.0", "CC0": "CC0-1.0"}
TEMPLATES = {family: (*texts, *([f"SPDX-License-Identifier: {TAGS[family]}"] if family in TAGS else [])) for family, texts in TEMPLATES.items()}
#: Prose that is no licence, near misses among it.
OTHER = (
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said",
    "you need a license to drive a car in this state and the version you have is too old",
    "the general public was free to use the park under the terms of the old agreement",
    "apache helicopters and the source of the river were seen in the film released this year",
    "students at MIT work on software and publish under their own names",
    "the mozilla foundation released a new version of the browser for general use",
    "public works are paid by the city and the work is under way",
    "read the documentation files before use and obtain a copy of the manual",
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def grams(words: list[bytes]) -> list[bytes]:
    return words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def training_paragraphs(templates_of: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[list[bytes], str]]:
    rng = random.Random(SEED)
    prose = [w for line in OTHER for w in words_of(line.encode())]
    out = []

    def filler(n: int) -> list[bytes]:
        return [rng.choice(prose) if rng.random() < 0.7 else bytes(rng.choices(b"aeiorstnlu", k=rng.randint(2, 9))) for _ in range(n)]

    for family, templates in templates_of.items():
        for template in templates:
            words = words_of(template.encode())
            out.append((words, family))
            for _ in range(VARIATIONS):
                own = [w for w in words if rng.random() > 0.04]
                out.append((filler(rng.choice((0, 0, 4, 12))) + own + filler(rng.choice((0, 0, 4, 12))), family))
    for line in OTHER:
        words = words_of(line.encode())
        out += [([w for w in words if rng.random() > 0.2] + filler(rng.randint(0, 8)), UNKNOWN) for _ in range(VARIATIONS)]
    # words of a notice out of order, and single words of it, are no notice
    for templates in templates_of.values():
        for template in templates:
            words = words_of(template.encode())
            for _ in range(VARIATIONS // 3):
                few = rng.sample(words, max(1, len(words) // 3)) + filler(6)
                rng.shuffle(few)
                out.append((few, UNKNOWN))
    return out


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    templates: dict[str, list[set]]

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        z = (self.weights[ids].sum(0) / np.sqrt(max(1, len(ids))) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, words: list[bytes]) -> tuple[str, float]:
        """Family and probability; unknown where no family is probable enough or no template confirms it."""
        vocabulary = self.vocabulary
        known = [w in vocabulary for w in words]
        if not any(known):
            return UNKNOWN, 0.0
        ids = list(dict.fromkeys(k for g in grams(words) if (k := vocabulary.get(g)) is not None))
        p = self.probabilities(np.array(ids))
        family = self.families[int(np.argmax(p))]
        if family == UNKNOWN or p.max() < self.least or not self.confirmed(words, family):
            return UNKNOWN, float(p.max())
        return family, float(p.max())

    def confirmed(self, words: list[bytes], family: str) -> bool:
        of_size: dict[int, set] = {}
        for template in self.templates[family]:
            size = len(next(iter(template)))
            own = of_size.setdefault(size, shingles(words, size))
            if len(template & own) >= CONTAINMENT * len(template):
                return True
        return False


class Windows:
    """Where the templates' shingles lie in the words of several lines."""

    def __init__(self, templates: dict[str, list[set]]):
        self.templates = [(len(t), len(next(iter(t)))) for ts in templates.values() for t in ts]
        self.index: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for k, t in enumerate(t for ts in templates.values() for t in ts):
            for s in t:
                self.index.setdefault(len(s), {}).setdefault(s, []).append(k)
        self.starts = {size: {s[0] for s in own} for size, own in self.index.items()}

    def search(self, words: list[bytes]) -> list[tuple[int, int]]:
        """First and last word of the windows, by template and place."""
        places: dict[int, list[tuple[int, tuple[bytes, ...]]]] = {}
        for size, own in self.index.items():
            starts = self.starts[size]
            for at, word in enumerate(words):
                if word in starts and (shingle := tuple(words[at : at + size])) in own:
                    for k in own[shingle]:
                        places.setdefault(k, []).append((at, shingle))
        return sorted({w for k, found in places.items() for w in self.of_template(found, *self.templates[k])})

    @staticmethod
    def of_template(found: list[tuple[int, tuple[bytes, ...]]], n: int, size: int) -> Iterator[tuple[int, int]]:
        reach, least, first, count, full = 2 * (n + size - 1), CONTAINMENT * n, 0, Counter(), False
        for last, (at, shingle) in enumerate(found):
            if full and (at - found[first][0] + size > reach or count[shingle]):
                yield found[first][0], found[last - 1][0] + size - 1
                first, count, full = last, Counter(), False
            count[shingle] += 1
            while at - found[first][0] + size > reach or count[found[first][1]] > 1:
                count[found[first][1]] -= 1
                count += Counter()
                first += 1
            full = len(count) >= least
        if full:
            yield found[first][0], found[-1][0] + size - 1


def runs(lines: list[bytes], words: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """First line and end of the runs of at least two lines that aren't blank."""
    first = 0
    for k in range(len(lines) + 1):
        if k == len(lines) or not words[k] and not lines[k].strip(MARKS):
            if k - first > 1:
                yield first, k
            first = k + 1


def cues(templates: dict[str, list[set]]) -> set[bytes]:
    """Words of which every confirmed paragraph has one, so that only paragraphs with one need to be classified.

    A template's shingles without such a word are fewer than confirm it; where they would be more, more of its words
    count, the longest first.
    """
    prose = {w for line in OTHER for w in words_of(line.encode())}
    own = {w for ts in templates.values() for t in ts for s in t for w in s} - prose
    for t in (t for ts in templates.values() for t in ts):
        more = sorted({w for s in t for w in s} - own, key=lambda w: (len(w), w))
        while sum(own.isdisjoint(s) for s in t) >= CONTAINMENT * len(t):
            own.add(more.pop())
    return own


def left_out_families(rounds: int = 60) -> tuple[int, int]:
    """How many templates get their family from a model that has learned all but them, and how many there are.

    Only families that keep another template count. This is the classifier alone, without the comparison.
    """
    right = total = 0
    for family, texts in TEMPLATES.items():
        for text in texts if len(texts) > 2 else ():
            model = train(rounds, templates_of=TEMPLATES | {family: tuple(t for t in texts if t != text)})
            ids = list(dict.fromkeys(k for g in grams(words_of(text.encode())) if (k := model.vocabulary.get(g)) is not None))
            right += bool(ids) and model.families[int(np.argmax(model.probabilities(np.array(ids))))] == family
            total += 1
    return right, total


def train(rounds: int = 150, l2: float = 1e-4, templates_of: dict[str, tuple[str, ...]] = TEMPLATES) -> Model:
    rows = training_paragraphs(templates_of)
    families = [*TEMPLATES, UNKNOWN]
    left_out = np.arange(len(rows)) % 5 == 4
    count = Counter(g for k, (words, _) in enumerate(rows) if not left_out[k] for g in set(grams(words)))
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, n in count.items() if n >= 3))}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (words, _) in enumerate(rows):
        ids = list({vocabulary[g] for g in grams(words) if g in vocabulary})
        if ids:
            x[i, ids] = 1 / np.sqrt(len(ids))
    y = np.array([families.index(f) for _, f in rows])
    fit, test = ~left_out, left_out
    w, b = np.zeros((x.shape[1], len(families)), np.float32), np.zeros(len(families), np.float32)
    xf, xt, hot = x[fit], np.ascontiguousarray(x[fit].T), np.eye(len(families), dtype=np.float32)[y[fit]]
    vw, vb = w.copy(), b.copy()
    for _ in range(rounds):
        z = xf @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        vw = 0.9 * vw - 4.0 * (xt @ (p - hot) / len(xf) + l2 * w)
        vb = 0.9 * vb - 4.0 * (p - hot).mean(0)
        w, b = w + vw, b + vb
    z, truth = x[test] @ w + b, y[test]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(truth)), truth]).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    p /= p.sum(1, keepdims=True)
    guess, top = p.argmax(1), p.max(1)

    def right(least: float) -> float:
        said = np.where(top >= least, guess, families.index(UNKNOWN))
        return float((said == truth).mean())

    least = max((0.3, 0.4, 0.5, 0.6, 0.7), key=right)
    templates = {f: [shingles(ws, min(SHINGLE, len(ws))) for ws in (words_of(t.encode()) for t in ts)] for f, ts in TEMPLATES.items()}
    return Model(families, vocabulary, w.astype(np.float32), b, temperature, least, templates)


def wrapped(model: Model, windows: Windows, lines: list[bytes], words: list[list[bytes]], cued: list[bool], found: list[dict]) -> list[dict]:
    """The licence paragraphs that cross line ends; `found` are those of single lines."""
    taken, more = {(x["line"], x["family"]) for x in found}, []
    for first, end in runs(lines, words):
        if not any(cued[first:end]):
            continue
        joined = [w for ws in words[first:end] for w in ws]
        line_of = [k for k in range(first, end) for _ in words[k]]
        for a, b in windows.search(joined):
            if line_of[a] == line_of[b]:
                continue
            family, p = model.predict(joined[a : b + 1])
            own = {(k, family) for k in range(line_of[a], line_of[b] + 1)}
            if family != UNKNOWN and taken.isdisjoint(own):
                taken |= own
                more.append({"line": line_of[a], "family": family, "probability": p})
    return more


def scan(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, found (line number from 0, family, probability of each licence paragraph)."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())  # a few MB, fixed by the templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        cue = cues(own.templates)
        windows = Windows(own.templates)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                found, lines = [], text.lower().split(b"\n")
                words = [WORD.findall(line) for line in lines]
                cued = [not cue.isdisjoint(ws) for ws in words]
                for k, ws in enumerate(words):
                    if cued[k]:
                        family, p = own.predict(ws)
                        if family != UNKNOWN:
                            found.append({"line": k, "family": family, "probability": p})
                if any(cued):
                    found += wrapped(own, windows, lines, words, cued, found)
                    found.sort(key=lambda x: x["line"])
                out.append((doc_id, sum(1 for line in lines if line.strip()), found))
            yield pd.DataFrame(out, columns=["doc_id", "n_paragraphs", "found"]).astype({"doc_id": "Int64"})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return source.mapInPandas(run, "doc_id long, n_paragraphs long, found array<struct<line:int,family:string,probability:double>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_licence"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"),
        F.array_max(F.transform("found", lambda x: x["probability"])).alias("probability"),
    )
