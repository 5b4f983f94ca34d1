"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text's words are its runs of letters and digits, lower-cased; white space, line ends and marks (of comments, say) between
them don't count. With a and b the numbers of bigrams (with repeats) of a window of words and a template, and c those in
common, Dice = 2 c / (a + b). To reach the threshold t, a window has to be of at most b (2 - t) / t bigrams, of which at least
b t / (2 - t) are the template's: these size bounds prune a text's candidate templates to those of which it has so many
bigrams close together. Windows begin and end at such bigrams, wherever these stand, within a line or over many.

Of windows that overlap the one with the most bigrams in common holds, then the one with the higher coefficient; of
different licences that tie, all. One pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

THRESHOLD = 0.8
# Notices and texts of well-known licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "All-Rights-Reserved": ["All rights reserved."],
}
_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> Counter:
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:]))


class Scanner:
    """Templates with the number of their bigrams, and the templates of each bigram."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, b, sum(b.values())) for name, texts in templates.items() for b in map(bigrams, texts) if b]
        self.of: dict[tuple[str, str], list[int]] = {}
        for k, (_, b, _) in enumerate(self.templates):
            for pair in b:
                self.of.setdefault(pair, []).append(k)
        self.words = frozenset(w for pair in self.of for w in pair)

    def _windows(self, k: int, at: list[int], words: list[str]) -> Iterator[tuple[int, float, int, int]]:
        """Bigrams in common, Dice, first and last word of the best window of template k from each of its bigrams on. at: where these stand."""
        _, template, n = self.templates[k]
        least, most = n * self.threshold / (2 - self.threshold), n * (2 - self.threshold) / self.threshold
        for i, start in enumerate(at):
            if i + least > len(at) or at[min(len(at) - 1, i + math.ceil(least) - 1)] - start + 1 > most:
                continue
            seen: Counter = Counter()
            both, best = 0, None
            for place in at[i:]:
                a = place - start + 1
                if a > most:
                    break
                pair = (words[place], words[place + 1])
                seen[pair] += 1
                both += seen[pair] <= template[pair]
                dice = 2 * both / (a + n)
                if dice >= self.threshold and (best is None or (both, dice) > best[:2]):
                    best = (both, dice, start, place + 1)
            if best:
                yield best

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """start, end (code points), licence and Dice coefficient of each window that holds."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # letters whose lower case is longer stay, so that places in low are the text's
            low = "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text)))
        words = _WORD.findall(low)
        known = list(map(self.words.__contains__, words))
        places: dict[int, list[int]] = {}
        for i in itertools.compress(range(len(words) - 1), map(and_, known, known[1:])):
            for k in self.of.get((words[i], words[i + 1]), ()):
                places.setdefault(k, []).append(i)
        found = {(*w, self.templates[k][0]) for k, at in places.items() if len(at) >= self.templates[k][2] * self.threshold / (2 - self.threshold) for w in self._windows(k, at, words)}
        kept: list[tuple] = []
        firsts: list[int] = []  # kept by place: those that overlap a window are neighbours
        for w in sorted(found, key=lambda w: (-w[0], -w[1], w[2:])):
            i = bisect_left(firsts, w[2])
            near = kept[max(0, i - self._depth): i + self._depth]
            if all(o[3] < w[2] or w[3] < o[2] or (o[:2] == w[:2] and o[4] != w[4]) for o in near):
                firsts.insert(i, w[2])
                kept.insert(i, w)
        spans = [m.span() for m in _WORD.finditer(low)] if kept else []
        return sorted((spans[w[2]][0], spans[w[3]][1], w[4], w[1]) for w in kept)

    #: Windows that may hold at one place: ties of different licences.
    @property
    def _depth(self) -> int:
        return len(self.templates) + 1


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and `licences`: an array of start, end, licence, dice, for each row of docs (doc_id, text).

    A null or empty text has none. Repeated rows get a row each; an empty table gives none; other columns are ignored.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("licences", pa.list_(span))])
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        for batch in batches:
            ids, found = [], []
            for doc_id, text in common.rows(iter([batch]), "doc_id", "text"):
                ids.append(doc_id)
                found.append([dict(zip(("start", "end", "licence", "dice"), f)) for f in scanner.scan(text)])
            yield common.emit(schema, [ids, found])

    return common.small_batches(docs).select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(common.tidy(run), "doc_id bigint, licences array<struct<start: bigint, `end`: bigint, licence: string, dice: double>>")
