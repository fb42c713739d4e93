"""Licence notices by a trained paragraph classifier.

A sparse logistic regression over word 1- to 3-grams names the licence family of a paragraph, or none. It is trained on
variants of the templates below and, as the class of no licence, on paragraphs from a bounded sample of the corpus. Its
scores are divided by a temperature fitted on variants it has not seen, and a threshold on the resulting probability makes
the unknown class. A prediction stands only if a template of the family confirms it: at least `CONFIRMED` of the template's
word pairs must stand in the unit that is classified: a line, or a run of words over several lines (a wrapped notice) that
is no longer than `REACH` times the template. A run does not cross a line without words.

Lines in which a word such as "licence" stands and no family is confirmed are classified too: where the classes of licences,
those of unlisted ones among them, have the greater part of the calibrated probability, `unknown` is reported with it.

Only lines and paragraphs that hold the word pairs of some template, or such a word, are classified; no family is lost by
that, as all others fail the confirmation. All lines of all texts are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_steps, map_rows
from .tokens import Words, mix

# Public wordings of licence notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Released under the BSD license.",
        "Licensed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "Public-Domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "Proprietary": (
        "All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
# Short identifiers by family, and wordings of licences that have no family here.
IDENTIFIERS = {
    "Apache-2.0": ("Apache-2.0",), "MIT": ("MIT",), "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"), "GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later"),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"), "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "MPL-2.0": ("MPL-2.0",), "CC-BY": ("CC-BY-4.0",), "CC-BY-SA": ("CC-BY-SA-4.0",), "CC-BY-NC": ("CC-BY-NC-4.0",), "Public-Domain": ("CC0-1.0", "Unlicense"), "ISC": ("ISC",),
}
UNLISTED = (
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the EUPL.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This package is free software; you may redistribute it and/or modify it under the terms of the Artistic License.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License.",
    "Use of this software is governed by the Business Source License included in the LICENSE file.",
    "Distributed under the Boost Software License, Version 1.0.",
    "The contents of this file are subject to the Common Development and Distribution License.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "You may copy, distribute and use this work under the terms of the accompanying licence.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Artistic-2.0",
)
#: Sentences that use the words of licences and are none.
PLAIN = (
    "He lost his driving license on the way to work.",
    "The city will license two more taverns this year.",
    "She asked for permission to use the copy room.",
    "The warranty of the kettle ended in March.",
    "They argued about copyright in the evening class.",
    "A fishing licence costs ten crowns and is free of charge for children.",
    "The software of the heating was replaced last week.",
    "The terms of the lease were read aloud to the tenants.",
    "The public library has a copy of the general's letters.",
    "The licence plate had been changed.",
)
NONE, UNKNOWN = "none", "unknown"
#: Words of which a line must hold one to be looked at for a licence without a family.
CUES = ("license", "licensed", "licence", "licenced", "licenses", "licences", "copyright", "permission", "redistribute", "redistribution", "warranty", "spdx")
TABLE_BITS, GATE_BITS = 16, 20
CONFIRMED, PROBABLE = 0.6, 0.5
#: A run over several lines may have so many times the words of the template that confirms it.
REACH = 1.5
SAMPLE_ROWS = 150


def _pairs(words: Words) -> np.ndarray:
    """Hash of each word with the next; at a text's last word, of no use."""
    return mix(words.hash + mix(np.roll(words.hash, -1)))


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table index and text of every word 1-, 2- and 3-gram, text after text."""
    h, n = words.hash, len(words.hash)
    left = np.repeat(words.first + words.counts, words.counts) - np.arange(n)
    rolled = np.concatenate([h, np.zeros(2, np.uint64)])
    two = h + mix(rolled[1 : n + 1])
    three = two + mix(rolled[2 : n + 2] ^ np.uint64(0xABCDEF))
    at = np.concatenate([np.arange(n), np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)])
    found = np.concatenate([mix(h ^ np.uint64(1)), mix(two ^ np.uint64(2))[left >= 2], mix(three ^ np.uint64(3))[left >= 3]])
    order = np.argsort(words.doc[at], kind="stable")
    return (found[order] >> np.uint64(64 - TABLE_BITS)).astype(np.int64), words.doc[at][order]


def _sums(table: np.ndarray, index: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, table.shape[1]))
    for k in range(table.shape[1]):
        out[:, k] = np.bincount(doc, table[index, k], n)
    return out / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))[:, None]


@dataclass
class Classifier:
    families: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    gate: np.ndarray
    known: np.ndarray  # word pairs of all templates, sorted
    holds: np.ndarray  # by word pair and template
    owner: np.ndarray  # family of each template
    reach: np.ndarray  # words that a run may span for each template
    needed: np.ndarray  # share of its word pairs that confirms each template
    cues: np.ndarray  # hashes of CUES, sorted

    def probabilities(self, texts: list[str]) -> np.ndarray:
        index, doc = _grams(Words(texts))
        z = (_sums(self.table, index, doc, len(texts)) + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def _covered(self, unit: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units (lines or paragraphs) and templates of which they hold a sufficient share of the word pairs, and that share."""
        if not len(unit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        keys = np.unique(unit * len(self.known) + place)
        units, first = np.unique(keys // len(self.known), return_index=True)
        share = np.add.reduceat(self.holds[keys % len(self.known)].astype(np.int64), first) / self.holds.sum(axis=0)
        i, t = np.nonzero(share >= self.needed)
        return units[i], t, share[i, t]

    def scan(self, texts: list[str]) -> list[tuple[int, int, str, float, float]]:
        """(text, first line, family, probability, share of the best template's word pairs) of each confirmed notice.

        A notice stands in one line, or in a run of words over several lines of one paragraph. Of notices that share words
        the one with the greater share of its template stays, from the first line of any of its family.
        """
        words = Words(texts)
        if len(words.hash) < 2:
            return []
        breaks = np.concatenate([[0], np.cumsum(words.points == 10)])
        line = breaks[words.start]
        joined = (words.doc[1:] == words.doc[:-1]) & (np.diff(line) <= 1)
        paragraph = np.concatenate([[0], np.cumsum(~joined)])
        pairs = _pairs(words)[:-1]
        at = np.flatnonzero(joined & self.gate[pairs >> np.uint64(64 - GATE_BITS)])
        place = np.searchsorted(self.known, pairs[at]).clip(max=len(self.known) - 1)
        exact = self.known[place] == pairs[at]
        at, place = at[exact], place[exact]
        spans: list[tuple] = []  # words classified (first, end), then templates with their words (first, end), pairs and share
        inner = line[at] == line[at + 1]
        own, own_place = at[inner], place[inner]
        by_line: dict[int, list] = {}
        for n, t, share in zip(*(x.tolist() for x in self._covered(line[own], own_place)), strict=True):
            a, b = np.searchsorted(line[own], [n, n + 1])
            hits = own[a:b][self.holds[own_place[a:b], t]]
            by_line.setdefault(n, []).append((t, int(hits[0]), int(hits[-1]) + 2, share))
        for n, found in by_line.items():
            a, b = np.searchsorted(line, [n, n + 1])
            spans.append((int(a), int(b), found))
        for n, t, _ in zip(*(x.tolist() for x in self._covered(paragraph[at], place)), strict=True):
            a, b = np.searchsorted(paragraph[at], [n, n + 1])
            mine = self.holds[place[a:b], t]
            size = int(self.holds[:, t].sum())
            for count, first, end in _runs(at[a:b][mine].tolist(), place[a:b][mine].tolist(), float(self.needed[t]) * size, int(self.reach[t])):
                if line[first] != line[end - 1]:
                    spans.append((first, end, [(t, first, end, count / size)]))
        shown = [words.points[words.start[a] : words.end[b - 1]].tobytes().decode("utf-32-le", "surrogatepass") for a, b, _ in spans]
        notices = []
        for (a, _, found), p in zip(spans, self.probabilities(shown) if shown else (), strict=True):
            best = int(p.argmax())
            fit = [(share, int(self.holds[:, t].sum()), first, end) for t, first, end, share in found if self.owner[t] == best]
            if fit and p[best] >= PROBABLE:
                share, size, first, end = max(fit)
                notices.append((-share, -size, end - first, first, end, a, best, float(p[best])))
        taken, out = np.full(len(words.hash), -1), []
        for share, _, _, first, end, a, best, chance in sorted(notices):
            text = int(words.doc[a])
            at_line = int(line[a] - breaks[words.text_start[text]])
            others = set(taken[first:end].tolist()) - {-1}
            if not others:
                taken[first:end] = len(out)
                out.append((text, at_line, self.families[best], chance, -share))
            elif len(others) == 1 and out[k := others.pop()][2] == self.families[best] and at_line < out[k][1]:
                out[k] = (text, at_line, *out[k][2:])
        out += self._unknown(words, line, taken >= 0, breaks)
        return sorted(out)

    def _unknown(self, words: Words, line: np.ndarray, taken: np.ndarray, breaks: np.ndarray) -> list[tuple[int, int, str, float, float]]:
        """Lines with a cue, outside the confirmed notices, that are more likely a licence than none."""
        place = np.searchsorted(self.cues, words.hash).clip(max=len(self.cues) - 1)
        cued = np.setdiff1d(line[self.cues[place] == words.hash], line[taken])
        if not len(cued):
            return []
        first, end = np.searchsorted(line, cued), np.searchsorted(line, cued, "right")
        shown = [words.points[words.start[a] : words.end[b - 1]].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(first, end, strict=True)]
        chance = 1 - self.probabilities(shown)[:, self.families.index(NONE)]
        texts = words.doc[first]
        return [(int(d), int(n - breaks[words.text_start[d]]), UNKNOWN, float(p), 0.0) for d, n, p in zip(texts, cued, chance, strict=True) if p >= PROBABLE]


def _runs(at: list[int], place: list[int], least: float, reach: int) -> list[tuple[int, int, int]]:
    """(distinct word pairs, first word, end) of runs of up to `reach` words with `least` pairs, the fullest first, none overlapping."""
    found, held, j = [], {}, 0
    for i, begin in enumerate(at):
        while j < len(at) and at[j] + 2 - begin <= reach:
            held[place[j]] = held.get(place[j], 0) + 1
            j += 1
        if len(held) >= least:
            seen, last = set(), i
            for k in range(i, j):
                if place[k] not in seen:
                    seen.add(place[k])
                    last = k
            found.append((-len(seen), at[last] + 2 - begin, begin))
        if j > i:
            held[place[i]] -= 1
            if not held[place[i]]:
                del held[place[i]]
    out: list[tuple[int, int, int]] = []
    for count, size, begin in sorted(found):
        if all(begin + size <= a or begin >= b for _, a, b in out):
            out.append((-count, begin, begin + size))
    return out


def _templates(family: str) -> tuple[str, ...]:
    return (*TEMPLATES[family], *(f"SPDX-License-Identifier: {x}" for x in IDENTIFIERS.get(family, ())))


def _variants(rng: np.random.Generator, filler: list[str], copies: int) -> tuple[list[str], list[str]]:
    texts, families = [], []
    for family, templates in (*((f, _templates(f)) for f in TEMPLATES), (UNKNOWN, UNLISTED), (NONE, PLAIN)):
        for template in templates:
            for c in range(copies):
                words = template.split()
                if c and len(words) > 4:
                    words = [w for w in words if rng.random() > 0.07]
                text = " ".join(words)
                text = (text, text.upper(), text.lower())[int(rng.integers(3)) if c > 1 else 0]
                if c > 2 and filler:
                    text = " ".join((*rng.choice(filler, int(rng.integers(0, 6))), text, *rng.choice(filler, int(rng.integers(0, 6)))))
                texts.append(text)
                families.append(family)
    return texts, families


def fit(paragraphs: list[str], copies: int = 12, passes: int = 60, seed: int = 7) -> Classifier:
    """Softmax regression on template variants and the given paragraphs; the temperature is chosen on fresh variants."""
    rng = np.random.default_rng(seed)
    names = [*TEMPLATES, UNKNOWN, NONE]
    split = [(k, w, np.unique(_pairs(w)[:-1])) for k, f in enumerate(TEMPLATES) for t in _templates(f) for w in [Words([t])]]
    needed = np.array([1.0 if t.startswith("SPDX") or len(t.split()) < 4 else CONFIRMED for f in TEMPLATES for t in _templates(f)])
    known = [[p for o, _, p in split if o == k] for k in range(len(TEMPLATES))]
    gate = np.zeros(1 << GATE_BITS, bool)
    every = np.unique(np.concatenate([p for ps in known for p in ps]))
    gate[every >> np.uint64(64 - GATE_BITS)] = True
    clean = [p for p in paragraphs if (w := Words([p])).counts.sum() < 2 or not max(float(np.isin(t, _pairs(w)[:-1]).mean()) >= 0.5 for ps in known for t in ps)]
    filler = [w for p in clean[:200] for w in p.split()][:4000]
    sets = []
    for share in (clean[::2], clean[1::2]):
        texts, families = _variants(rng, filler, copies)
        texts, families = texts + share, families + [NONE] * len(share)
        index, doc = _grams(Words(texts))
        sets.append((index, doc, np.array([names.index(f) for f in families]), len(texts)))
    (index, doc, y, n), (index2, doc2, y2, n2) = sets
    table, bias = np.zeros((1 << TABLE_BITS, len(names))), np.zeros(len(names))
    scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    weight = 1 / np.bincount(y, minlength=len(names)).clip(1)[y]
    used = np.unique(index)
    place = np.searchsorted(used, index)
    own, squares = np.zeros((len(used), len(names))), np.full((len(used), len(names)), 1e-8)
    for _ in range(passes):
        z = np.stack([np.bincount(doc, own[place, k], n) for k in range(len(names))], 1) * scale[:, None] + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= weight[:, None]
        g = np.stack([np.bincount(place, (p[:, k] * scale)[doc], len(used)) for k in range(len(names))], 1) + 1e-4 * own
        squares += g * g
        own -= 0.5 * g / np.sqrt(squares)
        bias -= 0.5 * p.sum(axis=0)
    table[used] = own
    z = _sums(table, index2, doc2, n2) + bias

    def loss(t: float) -> float:
        q = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(n2), y2]).mean())

    temperature = min((0.05 * 1.25**k for k in range(20)), key=loss)
    holds = np.stack([np.isin(every, p) for _, _, p in split], 1)
    reach = np.array([int(REACH * len(w.hash)) for _, w, _ in split])
    return Classifier(names, table.astype(np.float32), bias, temperature, gate, every, holds, np.array([k for k, _, _ in split]), reach, needed, np.sort(Words([' '.join(CUES)]).hash))


def _parts(text: str, size: int = 40) -> list[str]:
    """The lines of a text, and the runs of consecutive lines of a paragraph from `size` words on where they are shorter."""
    lines = [x for x in text.split("\n") if x.strip()]
    runs = []
    for paragraph in re.split(r"\n[^\S\n]*\n", text):
        held: list[str] = []
        for x in (*paragraph.split("\n"), None):
            if x is not None:
                held.append(x)
            if x is None or sum(len(y.split()) for y in held) >= size:
                if len(held) > 1:
                    runs.append("\n".join(held))
                held = []
    return [*lines, *(r for r in runs if r.strip())]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit with the lines and runs of lines of about `sample_rows` texts, chosen by a hash of their ids, as the class of no licence."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    texts = [r.text for r in rows.where(draw < int(min(1.0, sample_rows / max(1, n)) * (1 << 30))).toPandas().sort_values(["id", "text"]).itertuples()]
    return fit([p for t in texts for p in _parts(t)])


def scan_documents(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first line, family, probability, confirmed) for each licence notice; none for null or empty texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def each(batch: pa.RecordBatch):
        for first, texts in in_steps(batch.column(1).to_pylist()):
            found = sent.value.scan(texts)
            at = pa.array([first + f[0] for f in found], pa.int64())
            line, family, chance, share = ([f[k] for f in found] for k in range(1, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(line, pa.int64()), pa.array(family, pa.string()), pa.array(chance, pa.float64()), pa.array(share, pa.float64())], [id_col, "line", "family", "probability", "confirmed"])

    rows = docs.select(id_col, text_col)
    return map_rows(rows, each, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, line long, family string, probability double, confirmed double")
