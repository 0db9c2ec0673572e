"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a run of lines that wrapping has parted: comment marks and indentation go, lines are joined until a
blank line or one that ends a sentence.  A sparse multinomial logistic regression over word n-grams (1 to 3) gives
each paragraph a licence family or ``unknown``.  It learns from variants of the families' notices and texts below
(words dropped, text around them, wrapped parts) against ordinary paragraphs of the corpus, other licences, statements that
mention licences without granting one, and denials.  Wordings, other licences and statements are split in three: what
the weights are fitted on, what the temperature and the least probability are fitted on, and what :func:`report` tests,
so the unknown class is calibrated on licences and wordings that the weights never saw.  A predicted family is
confirmed if enough of one of its templates stands in the paragraph, or the paragraph in a template.

Only a paragraph with an anchor word (``ANCHORS``) can be a licence's; others are ``unknown`` without being scored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNKNOWN = "unknown"
WORDS = re.compile(r"[^\W_]+(?:[.+][0-9]+)*")
STOP = frozenset("a an and any are as at be by for from has in is it its may of on or other shall such that the this to was will with you your work file version".split())
#: Every notice and every part of a licence's text that can be told apart holds one of these.
ANCHORS = re.compile(r"licen[cs]|copyright|software|warrant|redistribut|public domain|unencumbered|creative commons|spdx|\b[al]?gpl|\b(?:mpl|mit|isc|bsd|cc0|cc|apache)\b", re.I)
MARKS = re.compile(r"^[\s#*/;%!>|\-]+|\s+(?:\*/)?$")

#: Share of a template (or of a part of one) that confirms a family.
CONFIRM = 0.75

#: Family -> its names, as notices write them.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"],
    "CC0": ["Creative Commons CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal", "CC0 1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "AGPLv3"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "LGPL-2.1", "LGPLv3"],
    "ISC": ["ISC License", "ISC licence"],
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

#: The families' own texts, sentence by sentence.
_PERMIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
TEXTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": _BSD,
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MIT": [
        _PERMIT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}

# Each list below is dealt out in turn: one for the weights, one for the calibration, one for the report, one for the weights again.
NOTICES = [
    "Licensed under the {}.", "You may use it under the {}.", "The library is provided under the {}.", "Released under the {}.",
    "This work is licensed under the {}.", "This project is available under the {}.", "Published under {}.", "SPDX-License-Identifier: {}",
    "The sources are made available under the {}.", "All files here fall under the {}.", "This code is covered by the {}.", "Distributed under the terms of the {}.",
    "License: {}", "This package is released under {}.", "Made available under the {}.", "Licensed under {}.",
    "Use of this source code is governed by the {}.", "It can be used under the {}.", "Usage is subject to the {}.", "This work is licensed under {}.",
]
#: Statements that mention licences and grant none of these.
OTHERS = [
    "All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "This software is proprietary and confidential.", "See the LICENSE file for details.", "A driving license is required.",
    "The license agreement between the parties ends in May.", "Unauthorized copying of this file is strictly prohibited.", "He lost his fishing license last year.", "Licensed to practice medicine in two states.",
    "Use of this product is subject to the end user license agreement.", "This document is released for internal use only.", "The software is provided to licensed users.", "The general public was invited.", "He works at MIT in Boston.",
    "The free software movement grew.", "The mozilla team released a new version.", "Permission to enter was granted.", "An apache helicopter landed.", "A commercial license may be bought from the vendor.", "Licensed under a custom license.",
    "Public domain images are rare.", "The creative team shares ideas in common.", "Copyright law changed in 1998.", "The warranty covers parts for two years.", "Students of MIT built the boat.", "The software update failed twice.",
    "A liquor license costs more every year.", "Copyright belongs to the publisher alone.", "The bus carried the general public and two licensed guides.", "Our software warranty is void if the seal is broken.", "Apache tribes lived in the south west.", "The license plate was missing.",
]
#: Other licences: to be unknown, whatever they have in common with the families.
FOREIGN = [
    "Boost Software License, Version 1.0", "Eclipse Public License, version 2.0", "zlib License", "Common Development and Distribution License, version 1.0", "SIL Open Font License, Version 1.1", "European Union Public Licence, version 1.2",
    "Artistic License 2.0", "Do What The F*ck You Want To Public License, Version 2", "Python Software Foundation License, Version 2", "Academic Free License, version 3.0", "Microsoft Public License", "Server Side Public License, version 1",
    "IBM Public License, Version 1.0", "Business Source License 1.1", "Open Software License 3.0", "PostgreSQL License", "EPL-2.0", "CDDL-1.0", "BSL-1.0", "OFL-1.1", "EUPL-1.2", "Ruby License", "Elastic License 2.0", "WTFPL",
]
#: Sentences that name a family's licence and deny it; they are dealt out by their verbs.
_DENIED = ["This file is not {} under the {{}}.", "It was never {} under the {{}}.", "The code is no longer {} under {{}}.", "The sources cannot be {} under the {{}}.", "No part is {} under {{}}.", "Neither file is {} under the {{}}.", "We have not {} it under the {{}}."]
_VERBS = ["licensed", "released", "published", "distributed", "made available", "covered", "provided", "used"]
DENIALS = [d.format(v) for d in _DENIED for v in _VERBS]
#: The same without the denial, so that it is the denying word that tells.
AFFIRMED = [d.format(v) for d in ("This file is {} under the {{}}.", "It was {} under {{}}.", "The sources are {} under the {{}}.") for v in _VERBS]


def _dealt(items: list, part: str) -> list:
    """The members of ``part`` (train, calibrate or report) of a list that is dealt out in turn."""
    at = {"train": (0, 3), "calibrate": (1,), "report": (2,)}[part]
    return [x for i, x in enumerate(items) if i % 4 in at]


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def ngrams(ws: list[str]) -> Iterable[tuple[str, ...]]:
    """Word n-grams with at least one word that is not a stop word."""
    for n in (1, 2, 3):
        for i in range(len(ws) - n + 1):
            g = tuple(ws[i : i + n])
            if not STOP.issuperset(g):
                yield g


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(number of the first line, joined text) of a text's paragraphs."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    first = 0
    for k, line in enumerate(text.split("\n")):
        plain = MARKS.sub("", line)
        if not held:
            first = k
        if plain:
            held.append(plain)
        if held and (not plain or plain[-1] in ".!?"):
            out.append((first, " ".join(held)))
            held = []
    if held:
        out.append((first, " ".join(held)))
    return out


def templates() -> dict[str, list[list[str]]]:
    """Each family's names and sentences as words; the sentences that both BSD families share are their common family's."""
    return {f: [words(x) for x in [*NAMES.get(f, []), *TEXTS.get(f, [])]] for f in sorted({*NAMES, *TEXTS})}


class Classifier:
    """Trained weights, calibration and templates; small enough to travel with the tasks."""

    def __init__(self, ordinary: list[str], parts: int = 12, rounds: int = 150, seed: int = 5):
        self.templates = templates()
        self.classes = [*self.templates, UNKNOWN]
        self._pairs = {f: [set(zip(t, t[1:], strict=False)) or {(t[0],)} for t in ts] for f, ts in self.templates.items()}
        rng = random.Random(seed)
        fill = [w for t in ordinary for w in words(t)][:20_000] or ["text"]
        plain = [t for t in ordinary if not ANCHORS.search(t) or self.similarity(words(t))[1] < 0.5]
        train = self.cases("train", rng, fill, parts) + [(t, UNKNOWN) for t in plain]
        bare = self.cases("train", rng, [""], 0)  # words around a notice are no features
        self.index = {g: i for i, g in enumerate(sorted({g for t, _ in bare for g in ngrams(words(t))}))}
        self._fit(train, rounds)
        self.temperature, self.least = 1.0, 0.5
        held = self.cases("calibrate", rng, fill, 3)
        logits, y = self._logits([t for t, _ in held]), [self.classes.index(f) for _, f in held]
        self.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda s: -sum(math.log(max(self._soft(z / s)[k], 1e-12)) for z, k in zip(logits, y, strict=True)))
        # the least probability with which of the families found and confirmed in held-out cases at most one in thirty is wrong
        found = []
        for (t, f), z in zip(held, logits, strict=True):
            p = self._soft(z / self.temperature)
            name = self.classes[int(np.argmax(p))]
            if name != UNKNOWN and self.similarity(words(t), name)[1] >= CONFIRM:
                found.append((float(p.max()), name == f))
        found.sort()
        for i, (p, _) in enumerate(found):
            if sum(ok for _, ok in found[i:]) >= 29 / 30 * (len(found) - i):
                self.least = max(0.5, p)
                break

    def cases(self, part: str, rng: random.Random, fill: list[str], parts: int) -> list[tuple[str, str]]:
        """(paragraph, family or unknown) of one part of the split: no wording, other licence or statement is in two parts; families' texts come whole and as ``parts`` wrapped runs."""
        some = lambda: " ".join(rng.choice(fill) for _ in range(rng.randrange(0, 12)))

        def wrapped(t: str) -> str:
            """A run of 12 to 30 words of a long text, a few words lost."""
            ws = t.split()
            a = rng.randrange(0, max(1, len(ws) - 12))
            return " ".join(w for w in ws[a : a + rng.randrange(12, 30)] if rng.random() > 0.04)

        ws = _dealt(NOTICES, part)
        known = [(n.format(x), f) for f, names in NAMES.items() for x in names for n in ws]
        known += [(n.format(x), f) for n in _dealt(AFFIRMED, part) for f, names in NAMES.items() for x in names[:2]]
        known += [(x, f) for f, ts in TEXTS.items() for x in ts for _ in range(2)]
        known += [(wrapped(x), f) for f, ts in TEXTS.items() for x in ts if x.count(" ") > 14 for _ in range(parts)]
        foreign = [(n.format(x), UNKNOWN) for x in _dealt(FOREIGN, part) for n in ws]
        denied = [(n.format(x), UNKNOWN) for n in _dealt(DENIALS, part) for names in NAMES.values() for x in names[:2]]
        others = [(x, UNKNOWN) for x in _dealt(OTHERS, part) for _ in range(6)]
        base = known + foreign + denied + others
        return base + [(f"{some()} {t} {some()}", f) for t, f in base[::3]]

    def _rows(self, texts: list[str]) -> list[list[int]]:
        return [sorted({i for g in ngrams(words(t)) if (i := self.index.get(g)) is not None}) for t in texts]

    def _fit(self, train: list[tuple[str, str]], rounds: int, rate: float = 1.0, decay: float = 1e-4) -> None:
        n_of: dict[tuple, int] = {}
        for x, (_, f) in zip(self._rows([t for t, _ in train]), train, strict=True):
            key = (tuple(x), self.classes.index(f))
            n_of[key] = n_of.get(key, 0) + 1  # equal rows are one with their number as weight
        rows, y, times = [list(x) for x, _ in n_of], np.array([c for _, c in n_of]), np.array(list(n_of.values()), float)
        k = len(self.classes)
        weight = times / np.maximum(np.bincount(y, times, minlength=k)[y], 1)
        weight[y == k - 1] *= 4  # ordinary text is what most paragraphs are
        weight *= len(y) / weight.sum()
        r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        c = np.array([i for x in rows for i in x], np.int64)
        scale = 1 / np.sqrt(np.maximum(np.bincount(r, minlength=len(rows)), 1))
        self.weights, self.bias = np.zeros((len(self.index), k)), np.zeros(k)
        square, square_b = np.full_like(self.weights, 1e-8), np.full(k, 1e-8)
        target = np.eye(k)[y]
        starts = np.searchsorted(r, np.arange(len(rows)))
        empty = np.bincount(r, minlength=len(rows)) == 0
        order = np.argsort(c, kind="stable")
        heads = np.searchsorted(c[order], np.arange(len(self.index)))
        for _ in range(rounds):  # full-batch AdaGrad on the sparse rows
            z = np.add.reduceat(np.vstack([self.weights[c], np.zeros((1, k))]), np.minimum(starts, len(c)), axis=0)
            z[empty] = 0
            z = z * scale[:, None] + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target) * weight[:, None]
            gw = np.add.reduceat((g * scale[:, None])[r[order]], heads, axis=0) / len(y) + decay * self.weights
            gb = g.sum(axis=0) / len(y)
            square += gw**2
            square_b += gb**2
            self.weights -= rate * gw / np.sqrt(square)
            self.bias -= rate * gb / np.sqrt(square_b)

    def _logits(self, texts: list[str]) -> list[np.ndarray]:
        return [self.weights[x].sum(axis=0) / math.sqrt(max(len(x), 1)) + self.bias for x in self._rows(texts)]

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, ws: list[str], family: str | None = None) -> tuple[str | None, float]:
        """(family, share of the best template's word pairs that stand in the paragraph); longer templates win ties.

        Of a paragraph that is a part of a template (a wrapped line, at least 8 words) the share is its own.
        """
        own = set(zip(ws, ws[1:], strict=False))
        have = own | {(w,) for w in ws}
        best: tuple[float, int, str | None] = (0.0, 0, None)
        for f in [family] if family else self.templates:
            for pairs in self._pairs[f]:
                both = len(pairs & have)
                share = max(both / len(pairs), both / len(own) if len(own) >= 7 else 0.0)
                best = max(best, (share, len(pairs), f), key=lambda x: x[:2])
        return best[2], best[0]

    def classify(self, paragraph: str) -> tuple[str, float, float, bool]:
        """(family or unknown, its calibrated probability, template share, confirmed)."""
        if not ANCHORS.search(paragraph):
            return UNKNOWN, 1.0, 0.0, False
        x = self._rows([paragraph])[0]
        if not x:
            return UNKNOWN, 1.0, 0.0, False
        p = self._soft((self.weights[x].sum(axis=0) / math.sqrt(len(x)) + self.bias) / self.temperature)
        k = int(np.argmax(p))
        if self.classes[k] == UNKNOWN or p[k] < self.least:
            return UNKNOWN, float(p[-1]), 0.0, False
        _, share = self.similarity(words(paragraph), self.classes[k])
        return self.classes[k], float(p[k]), share, share >= CONFIRM


def report(classifier: Classifier, ordinary: list[str], parts: int = 3, seed: int = 11) -> dict[str, float]:
    """Shares over cases that neither weights nor calibration saw: precision and recall of confirmed families, and how many other licences, denials and statements stay unknown."""
    cases = classifier.cases("report", random.Random(seed), [w for t in ordinary for w in words(t)][:20_000] or ["text"], parts)
    found_in = lambda t: (lambda family, p, share, sure: family if sure else UNKNOWN)(*classifier.classify(t))
    got = [(found_in(t), f) for t, f in cases]
    found, known = [g for g in got if g[0] != UNKNOWN], [g for g in got if g[1] != UNKNOWN]
    rest = [g for g in got if g[1] == UNKNOWN]
    right = sum(a == b for a, b in known)
    return {"precision": right / max(1, len(found)), "recall": right / max(1, len(known)), "unknown_kept": sum(a == UNKNOWN for a, _ in rest) / max(1, len(rest)), "n": len(got)}


def ordinary(docs: DataFrame, sample: int = 300, lines: int = 2000) -> list[str]:
    """At most ``lines`` lines of the ``sample`` documents with the smallest hashes."""
    texts = docs.where("text IS NOT NULL")
    share = min(1.0, 4 * sample / max(1, texts.count()))  # so that tasks send few texts each, whatever their number
    low = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
    some = texts.where(low).select("text").orderBy(F.xxhash64("text"), "text").select(F.slice(F.split("text", "\n"), 1, 50).alias("p")).limit(sample).collect()
    return [x for r in some for x in r.p if len(x) < 2000][:lines]


def trained(docs: DataFrame, sample: int = 300, lines: int = 2000) -> Classifier:
    """A classifier whose ordinary paragraphs are those of :func:`ordinary`; a corpus without any serves, too."""
    return Classifier(ordinary(docs, sample, lines))


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), family, probability, similarity, confirmed: every licence paragraph of whole texts.

    Null and empty texts have none; repeated rows repeat their rows; an empty table gives none.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(classifier)  # some MB at most: its size follows the templates, not the input

    def run(batches):
        c = shared.value
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t or not ANCHORS.search(t):
                    continue
                for k, part in paragraphs(t):
                    family, p, share, sure = c.classify(part)
                    if family != UNKNOWN:
                        rows.append((d, k, family, round(p, 6), round(share, 6), sure))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], names=["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, paragraph int, family string, probability double, similarity double, confirmed boolean")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return scan(docs, trained(docs))
