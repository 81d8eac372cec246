"""License scans by Dice coefficient.

A unit of text (each line, and the whole text if it has several) is normalised: runs of anything but ASCII letters and
digits are blanks, letters are lower-cased. Units are compared with templates by the Dice coefficient of their bags of
word bigrams, 2 * common / (size + size). Sizes bound the coefficient from above, so that only templates within a factor
of (2 - least) / least of the unit's size are compared at all; most prose lines are near no template's size.

Notices that are no unit (wrapped over lines of a longer text, or inside a longer line) are found as windows of the text's
words, of any start and length. A window that reaches the least score holds least / (2 - least) of its template's bigrams,
so that only places that dense are scored; and its best form begins and ends with bigrams of the template. A template's
windows are taken by score, each apart from those before; where windows of several templates overlap, that of most common
bigrams counts. A window that overlaps a line's or the text's own match of the same licence is that match, and one that
overlaps a line's match with no more in common is left out.

Cases: null and empty text have no match; a very long text is worked on alone, whole; rows that repeat a text have the
same matches; a unit of fewer than two words has no bigrams and no match; of equal scores
the first template by name counts; an empty table gives an empty result; further columns pass through, but
for one of the result's name, which the result replaces.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import without

LEAST = 0.8
# Public licence notices and short licence texts, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
        "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        'notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_WORD = re.compile("[A-Za-z0-9]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def bigrams(found: list[str]) -> Counter:
    return Counter(zip(found, found[1:]))


class Matcher:
    """The best template of a unit."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.bags = {name: bigrams(words(text)) for name, text in sorted(templates.items())}
        self.near: dict[int, list[str]] = {}
        for name, bag in self.bags.items():
            size = bag.total()
            for other in range(1, int(size * (2 - least) / least) + 1):
                if 2 * min(size, other) >= least * (size + other):
                    self.near.setdefault(other, []).append(name)

    def __call__(self, found: list[str]) -> tuple[str, float] | None:
        names = self.near.get(len(found) - 1)
        if not names:
            return None
        own, best = bigrams(found), None
        for name in names:
            bag = self.bags[name]
            common = sum(min(n, bag[x]) for x, n in own.items() if x in bag)
            score = 2 * common / (len(found) - 1 + bag.total())
            if score >= self.least and (best is None or score > best[1]):
                best = name, score
        return best


class Window(NamedTuple):
    """The words first to end - 1 of a text."""

    first: int
    end: int
    license: str
    score: float
    common: int

    def meets(self, other: Window) -> bool:
        return self.first < other.end and other.first < self.end


class _Places:
    """Where a text has bigrams of one template, and the best window that begins at each."""

    CELLS = 1 << 18

    def __init__(self, name: str, size: int, most: int, least: float, at: np.ndarray, kinds: np.ndarray, allowed: np.ndarray):
        self.name, self.size, self.most, self.least, self.at = name, size, most, least, at
        # A bigram counts in windows that begin after its allowed[kind]-th occurrence before it.
        order = np.argsort(kinds, kind="stable")
        back = np.arange(len(order)) - allowed[kinds[order]]
        same = (back >= 0) & (kinds[order[np.maximum(back, 0)]] == kinds[order])
        self.after = np.empty(len(order), np.int64)
        self.after[order] = np.where(same, order[np.maximum(back, 0)], -1)

    def best(self, starts: np.ndarray, limits: np.ndarray) -> list[tuple[float, int, int]]:
        """For each start (an index of at): score, common bigrams and end of the best window up to the word of its limit."""
        found, width = [], min(self.most, len(self.at))
        for i in range(0, len(starts), step := max(1, self.CELLS // width)):
            first = starts[i : i + step, None]
            cells = first + np.arange(width)
            inside = cells < len(self.at)
            cells = np.minimum(cells, len(self.at) - 1)
            common = np.cumsum((self.after[cells] < first) & inside, axis=1)
            score = 2 * common / (self.at[cells] - self.at[first] + 1 + self.size)
            score[~inside | (self.at[cells] + 2 > limits[i : i + step, None])] = 0
            rows, last = np.arange(len(first)), score.argmax(axis=1)
            found += zip(score[rows, last].tolist(), common[rows, last].tolist(), (self.at[cells[rows, last]] + 2).tolist())
        return found

    def windows(self, starts: np.ndarray, taken: list[Window], end: int) -> list[Window]:
        """The best window that meets none taken, the best that meets neither these nor it, and so on."""
        if taken:
            taken = sorted(taken)
            low, high = np.array([w.first for w in taken]), np.array([w.end for w in taken])
            place = np.searchsorted(low, self.at[starts], "right")
            free = (place == 0) | (high[place - 1] <= self.at[starts])
            starts, limits = starts[free], np.append(low, end)[place[free]]
        else:
            limits = np.full(len(starts), end)
        limit = dict(zip(starts.tolist(), limits.tolist()))
        current: dict[int, tuple[float, int, int]] = {}
        heap: list[tuple[float, int, int]] = []

        def look(at: np.ndarray) -> None:
            for i, (score, common, stop) in zip(at.tolist(), self.best(at, np.array([limit[i] for i in at.tolist()]))):
                current[i] = score, common, stop
                if score >= self.least:
                    heapq.heappush(heap, (-score, i, stop))

        look(starts)
        found = []
        while heap:
            _, i, stop = heapq.heappop(heap)
            if i not in limit or current[i][2] != stop:
                continue
            first = int(self.at[i])
            found.append(Window(first, stop, self.name, *current[i][:2]))
            again = []
            for j in starts[np.searchsorted(self.at[starts], first - self.most - 1) : np.searchsorted(self.at[starts], stop)].tolist():
                if j in limit and self.at[j] >= first:
                    del limit[j]
                elif j in limit and limit[j] > first:
                    limit[j] = first
                    if current[j][0] >= self.least and current[j][2] > first:
                        again.append(j)
            if again:
                look(np.array(again))
        return found


class Windows:
    """The notices among a text's words."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        bags = {name: bag for name, text in sorted(templates.items()) if (bag := bigrams(words(text)))}
        self.ids = {w: i for i, w in enumerate(sorted({w for bag in bags.values() for pair in bag for w in pair}), 1)}
        pairs = sorted({(self.ids[a], self.ids[b]) for bag in bags.values() for a, b in bag})
        self.base = len(self.ids) + 1
        self.codes = np.array([a * self.base + b for a, b in pairs], np.int64)
        self.names, self.sizes = list(bags), [bag.total() for bag in bags.values()]
        self.allowed = np.array([[bag[x] for x in self._named(pairs)] for bag in bags.values()], np.int64).reshape(len(bags), len(pairs))
        self.fewest = np.array([int(np.ceil(n * least / (2 - least) - 1e-9)) for n in self.sizes], np.int64)
        self.most = [int(n * (2 - least) / least + 1e-9) for n in self.sizes]

    def _named(self, pairs: list[tuple[int, int]]) -> list[tuple[str, str]]:
        name = {i: w for w, i in self.ids.items()}
        return [(name[a], name[b]) for a, b in pairs]

    def __call__(self, ids: array, units: list[tuple[int, int, str]]) -> list[Window]:
        """Windows of a text given as self.ids (0: of no template), but for those that units (first word, end, licence) tell."""
        if len(ids) < 2 or not self.names:
            return []
        ids = np.frombuffer(ids, np.uint32).astype(np.int64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[at] * self.base + ids[at + 1]
        kinds = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[kinds] == code
        at, kinds = at[known], kinds[known]
        if len(at) < self.fewest.min():
            return []
        counts = np.bincount(kinds, minlength=len(self.codes))
        dense: dict[str, tuple[_Places, np.ndarray]] = {}
        for t in np.flatnonzero(np.minimum(counts, self.allowed).sum(axis=1) >= self.fewest).tolist():
            own = self.allowed[t][kinds] > 0
            place, n = at[own], max(1, int(self.fewest[t]))
            starts = np.flatnonzero(place[n - 1 :] - place[: len(place) - n + 1] < self.most[t])
            if len(starts):
                dense[self.names[t]] = _Places(self.names[t], self.sizes[t], self.most[t], self.least, place, kinds[own], self.allowed[t]), starts
        lines = []
        for first, end, name in units:
            if name in dense:
                places, starts = dense[name]
                starts = starts[(places.at[starts] >= first) & (places.at[starts] < end)]
                lines += places.windows(starts, [], end)[:1]
        taken: list[Window] = []
        while dense:
            found = sorted((w for places, starts in dense.values() for w in places.windows(starts, taken, len(ids))), key=lambda w: (-w.common, -w.score, w.license, w.first))
            lost = set()
            for w in found:
                if any(map(w.meets, taken)):
                    lost.add(w.license)
                else:
                    taken.append(w)
            dense = {name: x for name, x in dense.items() if name in lost}
        return sorted(w for w in taken if not any(w.meets(x) and (w.license == x.license or w.common <= x.common) for x in lines))


def scan(df: DataFrame, text: str = "text", result: str = "licenses", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """df with the matches of each whole text: array of (line, from 1, where a window begins, or 0 for the whole text; license; score)."""
    df = without(df, [result], text)
    at = df.columns.index(text)
    match = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType())])
    kind = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        windows, largest = Windows(templates, least), max(matcher.near, default=0)
        known = windows.ids.get
        for batch in batches:
            rows = []
            for value in batch.column(at):
                found, whole, lines = [], [], (value.as_py() or "").split("\n")
                ids, begins, units = array("I"), [], []
                for i, line in enumerate(lines, 1):
                    own = words(line)
                    begins.append(len(ids))
                    ids.extend([known(w, 0) for w in own])
                    if hit := matcher(own):
                        found.append({"line": i, "license": hit[0], "score": hit[1]})
                        units.append((begins[-1], len(ids), hit[0]))
                    if len(whole) <= largest + 1:
                        whole += own
                hit = matcher(whole) if len(lines) > 1 else None
                for w in windows(ids, units):
                    if hit is None or w.license != hit[0]:
                        found.append({"line": bisect_right(begins, w.first), "license": w.license, "score": w.score})
                if hit:
                    found.append({"line": 0, "license": hit[0], "score": hit[1]})
                rows.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, result])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(result, T.ArrayType(match))]))
