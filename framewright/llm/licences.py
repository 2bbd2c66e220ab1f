"""Operator 8: licence scans with a generalised suffix automaton of licence tokens.

All templates' word sequences build one suffix automaton whose states know every
template place at which they end. A text streams through it: after each word the
automaton's state is the longest suffix that stands in some template (its matching
statistic). Maximal matches of at least `MIN_MATCH` words become (text, template) segments; for
each template the best chain of segments in order, with text gaps of at most `MAX_GAP`
words, gives the share of the template that the text covers. Templates covered to
`COVERED` are labelled, with their spans.

Words are runs of ASCII letters and digits and non-ASCII characters, ASCII lower-cased. They
map to template word numbers by array look-ups; only runs of at least `MIN_MATCH`
consecutive template words enter the automaton, as no shorter run can hold a long match.

Nulls and rows: null and empty texts have no words, no labels and score 0; null ids and
repeated rows are each returned; overlapping places are all counted; of chains that cover equally
much the one that ends first counts; texts of any length are taken in blocks; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, WordHasher, slices

MIN_MATCH = 4
MAX_GAP = 12
COVERED = 0.75
#: Fixed by the contract: phrase, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Public licence texts, notices and usual one-line statements.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_hasher = WordHasher(NON_WORD)


def words(text: str | None) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Automaton:
    """A suffix automaton of several sequences; `ends[state]` lists (sequence, position) after which it may end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((k, i + 1))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, of: dict[int, int]) -> int:
        self.next.append(of)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the shorter strings that reach it through p."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def statistics(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest template string that ends after each word."""
        state, n = 0, 0
        for c in seq:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            yield state, n


def best_chain(segments: list[tuple[int, int, int]], size: int) -> tuple[int, int, int]:
    """(template words covered, text start, text end) of the best chain of (text end, template end, words).

    Segments come by text end. A chain's template pieces follow one another; a segment that
    overlaps its predecessor counts from there on; a text gap over MAX_GAP starts anew.
    """
    best, tree, ends, at = (0, 0, 0), [(0, 0)] * (size + 1), [(0, 0)] * (size + 1), None
    for end, t_end, n in segments:
        if at is not None and end - n - at > MAX_GAP:
            tree, ends = [(0, 0)] * (size + 1), [(0, 0)] * (size + 1)
        before, k = (0, 0), t_end - n
        while k > 0:
            before = max(before, tree[k])
            k -= k & -k
        start = -before[1] if before[0] else end - n
        got = (before[0] + n, -start)
        for k in range(t_end - n + 1, t_end):  # predecessors that this one overlaps
            if ends[k][0]:
                got = max(got, (ends[k][0] + t_end - k, ends[k][1]))
        start, ends[t_end] = -got[1], max(ends[t_end], got)
        if (got[0], -start, end) > (best[0], -best[1], best[2]):
            best = (got[0], start, end)
        k = t_end
        while k <= size:
            tree[k] = max(tree[k], got)
            k += k & -k
        at = end
    return best


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        seqs = [words(t) for _, t in templates]
        known = sorted({w for s in seqs for w in s} | {w for p, _ in phrases for w in words(p)})
        number = {w: i for i, w in enumerate(known)}
        h = np.array([next(_hasher.texts([w.encode()]))[1][0] for w in known], dtype=np.uint64)
        order = np.argsort(h)
        self.hash, self.number = h[order], order
        self.mask = np.zeros(1 << 16, dtype=bool)
        self.mask[(h >> np.uint64(48)).astype(np.int64)] = True
        self.sizes = [len(s) for s in seqs]
        self.automaton = Automaton([[number[w] for w in s] for s in seqs])
        self.phrases = [([number[w] for w in words(p)], label) for p, label in phrases]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Template word numbers of word hashes, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        may = np.flatnonzero(self.mask[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[may]), len(self.hash) - 1)
        ok = self.hash[at] == h[may]
        out[may[ok]] = self.number[at[ok]]
        return out

    def base(self, ids: np.ndarray) -> tuple[list[int], list[str]]:
        """Starts (each place once for each phrase) and labels of the base phrases."""
        starts, labels = [], []
        for seq, label in self.phrases:
            n = len(ids) - len(seq) + 1
            if n <= 0:
                continue
            hit = ids[:n] == seq[0]
            for j, c in enumerate(seq[1:], 1):
                hit &= ids[j : j + n] == c
            if hit.any():
                starts += np.flatnonzero(hit).tolist()
                labels.append(label)
        return starts, labels

    def segments(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Long maximal matches by template: (text end, template end, words), by text end."""
        edge = np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]]))
        out: dict[int, list[tuple[int, int, int]]] = {}
        a = self.automaton
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e - s < MIN_MATCH:
                continue
            stats = [*a.statistics(ids[s:e].tolist()), (0, 0)]
            for i in range(e - s):
                state, n = stats[i]
                if n >= MIN_MATCH and stats[i + 1][1] <= n:
                    for k, t_end in sorted(a.ends[state]):
                        out.setdefault(k, []).append((s + i + 1, t_end, n))
        return out

    def scan(self, h: np.ndarray) -> tuple:
        ids = self.numbers(h)
        starts, base = self.base(ids)
        labels, spans, score = set(base), [], 0.0
        for k, segs in self.segments(ids).items():
            got, s, e = best_chain(segs, self.sizes[k])
            share = min(1.0, got / self.sizes[k])
            score = max(score, share)
            if share >= COVERED:
                labels.add(self.labels[k])
                spans.append((self.labels[k], s, e, share))
        if base:
            score = 1.0
        first, last = (min(starts), max(starts)) if starts else (None, None)
        text = ",".join(f"{x}:{s}:{e}" for x, s, e, _ in sorted(set(spans)))
        return len(h), len(starts), first, last, ",".join(sorted(set(base))), ",".join(sorted(labels)), score, text


@cache
def scanner() -> Scanner:
    return Scanner()


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licence_spans"]
_KINDS = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: base places and labels, all labels, best coverage, and label:start:end word spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for _, texts in slices(b.column(1)):
                rows += [scan.scan(h) for _, h in _hasher.texts([(t or "").encode().lower() for t in texts])]
            cols = [ids, *zip(*rows, strict=True)] if rows else [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], NAMES)

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, licence_spans string")
