"""Licence scans: a trained paragraph classifier with calibrated unknown class, confirmed by comparison with templates.

Sparse word n-grams of the templates feed a multinomial logistic regression. It is trained on templates with words dropped, cut and
surrounded by ordinary words, against ordinary paragraphs of the corpus as the unknown class. A temperature fitted on a held-out part
calibrates the probabilities. A predicted family is confirmed if the paragraph holds most of one of the family's notices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, text_or_empty

#: Ordinary documents that the unknown class learns from at most (the first in hash order of their ids), and paragraphs of
#: them (the first in hash order of their texts).
ORDINARY_DOCUMENTS = 300
ORDINARY_PARAGRAPHS = 3000
#: Longer paragraphs teach nothing, so that what reaches the driver has a bound; scanned are all.
ORDINARY_LENGTH = 20_000
VARIANTS = 24
GRAMS = 3
#: Share of a notice's three-word runs that a paragraph must hold.
CONFIRM = 0.7
UNKNOWN = "unknown"

# Licence families and the notices by which texts commonly name them.
NOTICES = {
    "agpl-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license"),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
}
# The paragraphs of the short licences, and the further paragraphs that licences ask to be put into files.
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
PARAGRAPHS = {
    "agpl-3.0": ("You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        _AS_IS,
    ),
    "cc-by-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",),
    "cc-by-sa-4.0": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation."),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
}
NOTICES = {f: (*notices, *PARAGRAPHS.get(f, ())) for f, notices in NOTICES.items()}
FAMILIES = (UNKNOWN, *sorted(NOTICES))

_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(w: list[str], most: int = GRAMS) -> set[str]:
    return {" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)}


def _runs(w: list[str]) -> set[str]:
    n = min(GRAMS, len(w))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


_TEMPLATES = {f: [_runs(tokens(t)) for t in notices] for f, notices in NOTICES.items()}
VOCABULARY = {g: i for i, g in enumerate(sorted({g for notices in NOTICES.values() for t in notices for g in grams(tokens(t))}))}
_WORDS = frozenset(g for g in VOCABULARY if " " not in g)


def template_share(family: str, w: list[str]) -> float:
    """The largest share of one notice's runs that the words hold."""
    held = _runs(w) | grams(w)
    return max((len(t & held) / len(t) for t in _TEMPLATES.get(family, ())), default=0.0)


def found_grams(w: list[str]) -> list[int]:
    """Numbers of the vocabulary's n-grams in the words, each once, sorted; looks only at runs of the vocabulary's words."""
    out, run = set(), []
    for x in [*w, ""]:
        if x in _WORDS:
            run.append(x)
        elif run:
            out.update(v for g in grams(run) if (v := VOCABULARY.get(g)) is not None)
            run = []
    return sorted(out)


class LicenceModel:
    """Weights of each family, the unknown class first, and the temperature of their scores."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def probabilities(self, found: list[int], words: int) -> np.ndarray:
        x = (self.weights[:, found].sum(1) / np.sqrt(max(len(found), 1)) + self.weights[:, -1] * (len(found) / max(words, 1)) + self.bias) / self.temperature
        e = np.exp(x - x.max())
        return e / e.sum()


def _vector(w: list[str]):
    found = found_grams(w)
    scale = 1 / np.sqrt(max(len(found), 1))
    return Vectors.sparse(len(VOCABULARY) + 1, [*found, len(VOCABULARY)], [scale] * len(found) + [len(found) / max(len(w), 1)])


def fit_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ordinary: int = ORDINARY_DOCUMENTS, paragraphs: int = ORDINARY_PARAGRAPHS, seed: int = 11) -> LicenceModel:
    """Train on variants of the notices and on ``paragraphs`` whole paragraphs of ``ordinary`` documents at most, none of them longer
    than ORDINARY_LENGTH characters; half of a notice's runs make a paragraph
    no example of the unknown class. Works without any document, too: the unknown class then learns from shuffled words alone."""
    rng = np.random.default_rng(seed)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    chosen = rows.where("t is not null").select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(ordinary)  # ids alone are sorted
    some = rows.join(F.broadcast(chosen), "i")  # ``ordinary`` ids at most
    parts = some.select(F.explode(F.split("t", "\n")).alias("p")).where(F.length("p") <= ORDINARY_LENGTH)
    lines = parts.distinct().orderBy(F.xxhash64("p"), "p").limit(paragraphs)
    plain = [w for r in lines.collect() if (w := tokens(r["p"])) and max(template_share(f, w) for f in NOTICES) < 0.5]
    plain += [rng.permutation(sorted(_WORDS))[: rng.integers(1, 12)].tolist() for _ in range(60)]
    rows = [(0, w) for w in plain]
    for f, notices in NOTICES.items():
        for t in notices:
            w = tokens(t)
            rows.append((FAMILIES.index(f), w))
            for _ in range(VARIANTS):
                kept = [x for x in w if rng.random() > 0.08] or w
                around = plain[rng.integers(len(plain))]
                a = rng.integers(0, min(len(around), 12) + 1)
                rows.append((FAMILIES.index(f), [*around[:a], *kept, *around[a : a + rng.integers(0, 6)]]))
    fold = rng.random(len(rows)) < 0.8
    spark = docs.sparkSession
    frame = spark.createDataFrame([(float(y), _vector(w)) for (y, w), train in zip(rows, fold, strict=True) if train], ["label", "features"])
    fitted = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, standardization=False).fit(frame)
    model = LicenceModel(fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), 1.0)
    held = [(y, found_grams(w), len(w)) for (y, w), train in zip(rows, fold, strict=True) if not train]

    def loss(t: float) -> float:
        model.temperature = t
        return -sum(np.log(max(model.probabilities(g, n)[y], 1e-12)) for y, g, n in held)

    model.temperature = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    return model


_RUNS: dict[str, list[tuple[str, int]]] = {}
for _f, _sets in _TEMPLATES.items():
    for _t, _set in enumerate(_sets):
        for _r in _set:
            _RUNS.setdefault(_r, []).append((_f, _t))
#: Words that a notice may spread over, as a multiple of its runs.
SPREAD = 1.5


def paragraphs_of(text: str) -> list[list[list[str]]]:
    """The words of each line of each paragraph. Lines without a word, such as empty ones and bare comment marks, part paragraphs."""
    out: list[list[list[str]]] = [[]]
    for line in text.split("\n"):
        if w := tokens(line):
            out[-1].append(w)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def _windows(w: list[str], confirm: float) -> Iterator[tuple[str, int, int]]:
    """Families with the stretch of words that holds most of one of their notices."""
    met: dict[tuple[str, int], list[tuple[int, str]]] = {}
    for i, x in enumerate(w):
        if x in _WORDS:
            run = " ".join(w[i : i + GRAMS])
            for t in _RUNS.get(run, ()):
                met.setdefault(t, []).append((i, run))
    for (f, t), at in met.items():
        size = len(_TEMPLATES[f][t])
        if len({r for _, r in at}) < confirm * size:
            continue
        held, lo, best = {}, 0, (0, 0, 0)
        for i, r in at:
            held[r] = held.get(r, 0) + 1
            while i - at[lo][0] > SPREAD * size + GRAMS:
                held[at[lo][1]] -= 1
                if not held[at[lo][1]]:
                    del held[at[lo][1]]
                lo += 1
            best = max(best, (len(held), -at[lo][0], -(i + GRAMS)))
        if best[0] >= confirm * size:
            yield f, -best[1], -best[2]


def paragraph_notices(lines: list[list[str]], model: LicenceModel, confirm: float) -> tuple[list[tuple[float, float, str]], float]:
    """``share, probability, family`` of a paragraph's notices, one a family, and the least unknown probability of its parts.

    Looks at each line, at all lines together, and at stretches that hold most of a notice. What isn't confirmed counts only where no
    confirmed notice is.
    """
    w = [x for line in lines for x in line]
    parts, at = [], 0
    for line in lines:
        parts.append((at, at + len(line)))
        at += len(line)
    parts = [*parts, (0, at)] if len(lines) > 1 else parts
    found, least = [], 1.0
    for f, a, b in [*((None, a, b) for a, b in parts), *_windows(w, confirm)]:
        part = w[a:b]
        grams_in = found_grams(part) if not _WORDS.isdisjoint(part) else []
        p = model.probabilities(grams_in, len(part) if grams_in else 1)
        least = min(least, float(p[0]))
        k = int(p.argmax())
        if grams_in and k and f in (None, FAMILIES[k]):
            found.append((template_share(FAMILIES[k], part), float(p[k]), FAMILIES[k], a, b))
    sure = [x for x in found if x[0] >= confirm]
    best: dict[str, tuple[float, float, str]] = {}
    for x in found:
        if x[0] >= confirm or not any(x[3] < y[4] and y[3] < x[4] for y in sure):
            best[x[2]] = max(best.get(x[2], (-1.0,)), x[:3])
    return list(best.values()), least


OUT = "n_paragraphs long, n_notices long, family string, probability double, template_share double, confirmed boolean, paragraph_no int, notices array<struct<family:string,probability:double,template_share:double,confirmed:boolean,paragraph_no:int>>"


def _scanned(text: str, model: LicenceModel, confirm: float) -> tuple:
    """The values of OUT for one text."""
    found, least, parts = [], 1.0, paragraphs_of(text)
    for no, lines in enumerate(parts):
        got, unknown = paragraph_notices(lines, model, confirm)
        found += [(share, p, -no, f) for share, p, f in got]
        least = min(least, unknown)
    listed = [{"family": f, "probability": p, "template_share": share, "confirmed": share >= confirm, "paragraph_no": -no} for share, p, no, f in sorted(found, key=lambda x: (-x[2], x[3]))]
    if not found:
        return len(parts), 0, UNKNOWN, least, 0.0, False, -1, listed
    best = max(found)
    return len(parts), len(found), best[3], best[1], best[0], best[0] >= confirm, -best[2], listed


def scan_licences(docs: DataFrame, model: LicenceModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """One row per row of ``docs``: its paragraphs (of lines with words), the notices in them, the best of these, and all as ``notices``.

    A paragraph has one notice of a family at most; the best notice is a confirmed one, then the one with the largest template share,
    then the likeliest, then the first. Without notices, and for null and empty texts, ``family`` is ``unknown`` with the least unknown
    probability of any paragraph (1 without paragraphs), ``paragraph_no`` -1. Null ids stay null; repeated rows repeat; an empty table
    gives an empty result; other columns play no part.
    """
    model = model or fit_licences(docs, id_col=id_col, text_col=text_col)
    names = [x.split()[0] for x in OUT.split(", ")]

    def make():
        return lambda texts: dict(zip(names, zip(*(_scanned(t, model, confirm) for t in texts), strict=True), strict=True))

    return per_row(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), make, OUT)
