"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

Words (letters and digits, lower case) of each template are cut into 3-grams; winnowing keeps the least hash of every
WINDOW neighbouring ones, so any run of 3 + WINDOW - 1 template words in a text holds an indexed fingerprint. A template with
a fifth of its words changed has such a run if it is long enough; of shorter ones all 3-grams, or 2-grams, are
indexed, so that every text that keeps `least` of a template's words, with others in place of the rest, is a candidate.

The inverted index maps a fingerprint to its places in templates. In a document all grams made of template words are
looked up; hits of one template whose diagonals (place in the text less place in the template) lie within a band's
width make one candidate, and its stretch is aligned with the template inside that band and as much on either side. A
candidate is dropped before that if too few template words occur near their diagonals at all. All candidates of a
template in a text are aligned together, row by row of the template. Reported are stretches that hold at least `least` of
the template's words in order and all its numbers, so that versions aren't taken for each other; where reported
stretches overlap, the one with more matched words wins, of equals the one that covers more of its template.

Scale: a narrow map over the documents; the index is a few kilobytes and independent of the data; a text's work is its
hits times a template's length and band.

Defined cases: null, empty or wordless texts have no match; repeated rows each get their own; ties go to the template
that is named first, then to the earlier stretch; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, texts_of

# License notices as their publishers word them.
TEMPLATES = {
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-3.0-line": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-3.0-line": "Licensed under CC BY-SA 3.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
GRAM, WINDOW, LEAST = 3, 2, 0.8
#: Least width of a band; candidates of a text that are aligned together.
BAND, TOGETHER = 8, 256
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each window (the last of equals), each once; all of it if it is shorter."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    width = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.unique(np.arange(len(views)) + width - 1 - views.argmin(1))


def run_of(words: int, least: float) -> int:
    """Length of a run of kept words that every text has which keeps `least` of so many words in their places."""
    changed = words - int(np.ceil(least * words - 1e-9))
    return -(-(words - changed) // (changed + 1))


class TemplateIndex:
    """Numbered words, and the inverted index from fingerprints to (template, place)."""

    def __init__(self, templates: dict[str, str], least: float = LEAST) -> None:
        self.names = sorted(templates)
        texts = [words_of(templates[n]) for n in self.names]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.base = len(self.number) + 1
        self.templates = [np.array([self.number[w] for w in t], np.int64) for t in texts]
        self.figures = [{self.number[w] for w in t if w.isdigit()} for t in texts]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            run = run_of(len(t), least)
            size = GRAM if run >= GRAM else max(1, run)
            grams = self.grams(t, size)
            for p in winnow(self.mixed(grams), WINDOW if run >= GRAM + WINDOW - 1 else 1).tolist():
                places[int(grams[p])].append((i, p))
        self.places = dict(places)
        self.sorted = np.array(sorted(places), np.int64)
        self.sizes = sorted({n for t in self.templates for n in [min(GRAM, max(1, run_of(len(t), least)))]})

    def grams(self, numbers: np.ndarray, size: int = GRAM) -> np.ndarray:
        """Code of the gram of `size` words that starts at each place; 0 where it holds a word of no template."""
        if len(numbers) < size:
            return np.zeros(0, np.int64)
        out, known = np.zeros(len(numbers) - size + 1, np.int64), np.ones(len(numbers) - size + 1, bool)
        for j in range(size):
            part = numbers[j : len(numbers) - size + 1 + j]
            out, known = out * self.base + part, known & (part > 0)
        return np.where(known, out, 0)  # fewer words give smaller codes, as words are numbered from 1

    @staticmethod
    def mixed(grams: np.ndarray) -> np.ndarray:
        """A fixed scramble, so that winnowing doesn't favour words early in the alphabet."""
        x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def hits(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """(place in the text, indexed gram) of every gram that is a fingerprint."""
        out: list[tuple[int, int]] = []
        if not len(self.sorted):
            return out
        for size in self.sizes:
            grams = self.grams(numbers, size)
            at = np.flatnonzero(grams)
            spot = np.minimum(np.searchsorted(self.sorted, grams[at]), len(self.sorted) - 1)
            at = at[self.sorted[spot] == grams[at]]
            out += zip(at.tolist(), grams[at].tolist(), strict=True)
        return out


@lru_cache(4)
def _index(templates: tuple[tuple[str, str], ...], least: float = LEAST) -> TemplateIndex:
    return TemplateIndex(dict(templates), least)


def band_of(words: int, least: float) -> int:
    """Width of a template's bands: what may be missing of it fits in, and a short one's repetitions stay apart."""
    return min(max(BAND, words - int(least * words)), max(1, words // 3))


def align(template: np.ndarray, text: np.ndarray, lows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matched words, first and last + 1 in the text, of the best in-order match of each band.

    A band holds the pairs with text place - template place in [low, low + width). Of equal matches the one that starts
    last is taken, then the one that ends first.
    """
    far = np.int64(1) << 40  # a cell's value is far * matched words + where the match starts
    best = np.zeros((len(lows), width + 1), np.int64)
    top, end = np.zeros(len(lows), np.int64), np.zeros(len(lows), np.int64)
    columns = np.arange(width)
    for i, word in enumerate(template.tolist()):
        at = i + lows[:, None] + columns
        same = (text[np.clip(at, 0, max(0, len(text) - 1))] == word) & (at >= 0) & (at < len(text))
        longer = np.where(same, np.where(best[:, :width] > 0, best[:, :width], at + 1) + far, 0)
        # Skip the template's word (one diagonal down), or words of the text (the cells to the left).
        row = np.maximum.accumulate(np.maximum(longer, best[:, 1:]), axis=1)
        peak = longer.max(1)
        where = longer.argmax(1)  # the first of equals
        better = peak > top
        top, end = np.where(better, peak, top), np.where(better, i + lows + where + 1, end)
        best = np.concatenate([row, np.zeros((len(lows), 1), np.int64)], 1)
    return top // far, top % far - 1, end


def candidates(numbers: np.ndarray, template: np.ndarray, diagonals: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """First diagonal and width of the bands in which enough template words occur near their diagonals."""
    band = band_of(len(template), least)
    firsts, at = [], 0
    while at < len(diagonals):  # sorted: a band's hits lie within `band` of its first one
        firsts.append(diagonals[at])
        at = int(np.searchsorted(diagonals, diagonals[at] + band, "right"))
    lows, width = np.array(firsts, np.int64) - band, 3 * band + 1
    kept = []
    for a in range(0, len(lows), TOGETHER):
        some = lows[a : a + TOGETHER]
        found = np.zeros(len(some), np.int64)
        for i, word in enumerate(template.tolist()):
            here = i + some[:, None] + np.arange(width)
            found += ((numbers[np.clip(here, 0, len(numbers) - 1)] == word) & (here >= 0) & (here < len(numbers))).any(1)
        kept.append(some[found >= least * len(template) - 1e-9])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64), width


def scan_text(text: bytes, index: TemplateIndex, least: float = LEAST) -> list[tuple[str, int, float, int, int, int, int]]:
    """(license, matched words, coverage, start and end in words, start and end in characters) of each reported stretch."""
    shown = text.decode("utf-8", "replace")
    lowered = shown.lower()
    get = index.number.get
    numbers = np.array([get(w, 0) for w in WORD.findall(lowered)], np.int64)
    by_template: dict[int, set[int]] = defaultdict(set)
    for at, gram in index.hits(numbers):
        for template, p in index.places[gram]:
            by_template[template].add(at - p)
    found = set()
    for template, diagonals in by_template.items():
        words = index.templates[template]
        lows, width = candidates(numbers, words, np.array(sorted(diagonals), np.int64), least)
        for a in range(0, len(lows), TOGETHER):
            for matched, first, last in zip(*(x.tolist() for x in align(words, numbers, lows[a : a + TOGETHER], width)), strict=True):
                if matched >= least * len(words) - 1e-9 and index.figures[template] <= set(numbers[first:last].tolist()):
                    found.add((-matched, -matched / len(words), template, first, last))
    out, taken = [], []
    for negative, uncovered, template, first, last in sorted(found):
        at = bisect.bisect_left(taken, (first, last))
        if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or last <= taken[at][0]):
            taken.insert(at, (first, last))
            out.append((index.names[template], -negative, -uncovered, first, last))
    if not out:
        return []
    # Lower-casing may change a text's length, so characters are counted in the lower-cased text only if it doesn't.
    spans = [m.span() for m in WORD.finditer(lowered if len(lowered) == len(shown) else shown)]
    return [(n, m, c, a, z, spans[a][0], spans[z - 1][1]) for n, m, c, a, z in sorted(out, key=lambda o: o[3]) if z <= len(spans)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, matched, coverage, start_word, end_word, start_char, end_char): a row per reported stretch."""
    ship(docs.sparkSession)
    given = tuple(sorted((templates or TEMPLATES).items()))
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(given, least)
        for batch in batches:
            for b in pieces(batch, 1):
                rows = [(d, *r) for d, t in zip(b.column(0).to_pylist(), texts_of(b, 1), strict=True) for r in scan_text(t, index, least)]
                if rows:
                    kinds = [b.schema.field(0).type, pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = slim.select("doc_id").schema.add("license", "string").add("matched", "long").add("coverage", "double")
    for name in ("start_word", "end_word", "start_char", "end_char"):
        schema = schema.add(name, "long")
    names = schema.fieldNames()
    return slim.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document against all templates."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
