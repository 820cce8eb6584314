"""License scan: template words and winnowed fingerprints pick candidates, banded alignment measures them.

Templates and documents are words (A-Z lower-cased, runs of letters, digits and
non-ASCII characters). A place in the document less the place of the same word in the
template is a diagonal. Every band of 2 * BAND + 1 diagonals whose equal words cover
``least`` of the template's places is a candidate, so no match within such a band is
missed: one that leaves out k places at most has one of any k + 1, so only the
surroundings of the k + 1 least common words are counted.

Matches with wider gaps come from fingerprints: of each WINDOW consecutive GRAM-word
hashes of a template the smallest is posted in an inverted index with its template and
place. All GRAM-word hashes of a document are looked up; hits of one template whose
diagonals are within BAND of the next make a candidate of BAND diagonals to either side
of them, which may drift over DRIFT bands in all.

In a candidate's diagonals the template is aligned with the document's words, for
most matches with gaps in both. Coverage is matched words over the template's words;
matches of at least ``least`` coverage are reported, with the words of the document
they span. Of matches that overlap, the one of most matched words stays (ties: higher
coverage, then the template's name, the shorter span, the earlier place); the words
before and after it are aligned again, so each of several notices in a row is a match.

Templates are a parameter of fixed size; they travel in the task's code.

Nulls and oddities: a null or empty text has no match, so no row. Repeated rows give
repeated matches; null doc_ids are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.llm import flattext as ft
from quarrydex.llm.quality_rules import STOP_WORDS
from quarrydex.llm.scratch import small_batches
from quarrydex.llm.substring_dedup import member, sliding_min

GRAM = 3
WINDOW = 3
BAND = 8
#: Bands over which the diagonals of one match may drift in all.
DRIFT = 4
LEAST = 0.8

# Notices and texts of common public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


class TemplateIndex:
    """The inverted index of the templates' winnowed fingerprints, and the places and hashes of their words."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.gram = gram
        self.names = sorted(templates)
        self.words: list[list[bytes]] = []
        self.places: list[dict[bytes, list[int]]] = []
        self.hashes: list[np.ndarray] = []
        postings: dict[int, list[tuple[int, int]]] = {}
        for n, name in enumerate(self.names):
            (_, _, t), = ft.slices(pa.array([templates[name]]), 1 << 30)
            own, starts, ends, _ = ft.joined(t, ft.ALNUM_WORDS, lower=True)
            self.words.append(own.data[: own.off[-1]].tobytes().split())
            places: dict[bytes, list[int]] = {}
            for at, w in enumerate(self.words[-1]):
                places.setdefault(w, []).append(at)
            self.places.append(places)
            self.hashes.append(ft.word_hashes(own.data, starts, ends))
            h = ft.run_hashes(self.hashes[-1], gram)
            low = sliding_min(h, min(window, len(h))) if len(h) else h
            for k, m in enumerate(low.tolist()):
                at = k + int(np.argmin(h[k : k + window]))
                if (n, at) not in postings.setdefault(m, []):
                    postings[m].append((n, at))
        self.postings = postings
        self.keys = np.sort(np.array(list(postings), np.uint64))

    def need(self, n: int, least: float) -> int:
        """The fewest matched words that are ``least`` of template n."""
        size = len(self.words[n])
        return next((m for m in range(1, size + 1) if m >= least * size), size + 1)

    def anchors(self, n: int, need: int) -> np.ndarray:
        """Sorted hashes of words of which every match of ``need`` words of template n has one; common words come last."""
        words = self.words[n]
        rare = sorted(range(len(words)), key=lambda at: (words[at].decode() in STOP_WORDS, -len(words[at]), at))
        return np.unique(self.hashes[n][rare[: len(words) - need + 1]])


def align(template: list[bytes], words: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first matched word of the document, word after the last) of the best alignment whose diagonals lie from low to high.

    Most matches first, then the shortest span.
    """
    width = high - low + 1
    none = (0, 0, -1, -1)  # matches, minus span, first, last
    before = [none] * (width + 2)
    for i, w in enumerate(template):
        row = [none] * (width + 2)
        for k in range(width):
            j = i + low + k
            # columns of a row are diagonals: the same document word one template word back is one diagonal up
            best = max(before[k + 2], row[k])
            if 0 <= j < len(words) and words[j] == w:
                m, _, first, _ = before[k + 1]
                first = j if first < 0 else first
                best = max(best, (m + 1, first - j, first, j))
            row[k + 1] = best
        before = row
    m, _, first, last = max(before)
    return m, first, last + 1


def matches(index: TemplateIndex, column: pa.Array, band: int = BAND, least: float = LEAST) -> Iterator[tuple[int, str, int, int, int, int]]:
    """(row, template, matched words, template words, first word, word after the last)."""
    needs = [index.need(n, least) for n in range(len(index.names))]
    anchors = [index.anchors(n, need) for n, need in enumerate(needs)]
    vocabulary = [np.unique(h) for h in index.hashes]
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *vocabulary]))
    for i, _, t in ft.slices(column):
        own, starts, ends, first = ft.joined(t, ft.ALNUM_WORDS, lower=True)
        single = ft.word_hashes(own.data, starts, ends)
        h = ft.run_hashes(single, index.gram)
        hit = np.flatnonzero(member(h, index.keys) & ft.inside(first, index.gram))
        docs = np.searchsorted(first, hit, "right") - 1
        near: dict[int, list[tuple[int, int, int]]] = {}
        at = np.flatnonzero(member(single, every))
        for n, need in enumerate(needs):
            for d, x, y in _regions(at[member(single[at], vocabulary[n])], at[member(single[at], anchors[n])], first, need, len(index.words[n]) + 2 * band):
                near.setdefault(d, []).append((n, x, y))
        for d in sorted({*near, *docs.tolist()}):
            a = int(first[d])
            words = own.data[own.off[d] : own.off[d + 1]].tobytes().split(b" ")
            lines: dict[int, set[int]] = {}
            for p in hit[slice(*np.searchsorted(docs, [d, d + 1]))].tolist():
                for n, place in index.postings[int(h[p])]:
                    lines.setdefault(n, set()).add(p - a - place)
            bands = {(n, low - band, high + band) for n, diagonals in lines.items() for low, high in _near(sorted(diagonals), band)}
            for n, x, y in near.get(d, ()):
                bands.update((n, low, low + 2 * band) for low in _full(index.places[n], words, x, y, needs[n], 2 * band))
            found: list[tuple] = []

            def push(n: int, low: int, high: int, x: int, y: int) -> None:
                """The best match of a band within words x to y."""
                template = index.words[n]
                x, y = max(x, low), min(y, high + len(template))
                if y - x >= needs[n]:
                    m, p, q = align(template, words[x:y], low - x, high - x)
                    if m >= needs[n]:
                        heapq.heappush(found, (-m, -m / len(template), index.names[n], q - p, p + x, (n, low, high, x, y)))

            for n, low, high in bands:
                push(n, low, high, 0, len(words))
            begins: list[int] = []
            ends: list[int] = []
            while found:
                m, _, name, span, x, (n, low, high, lo, hi) = heapq.heappop(found)
                k = bisect.bisect_right(ends, x)  # the first taken match that ends after x
                if k == len(begins) or begins[k] >= x + span:
                    begins.insert(k, x)
                    ends.insert(k, x + span)
                    yield i + d, name, -m, len(index.words[n]), x, x + span
                # what is left of the band's words, before and after the match in the way
                push(n, low, high, lo, begins[k])
                push(n, low, high, ends[k], hi)


def _regions(at: np.ndarray, anchors: np.ndarray, first: np.ndarray, need: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(document, first word, word after the last) of the surroundings, less than ``reach`` words to either side, of anchors that have ``need`` of the words at ``at`` in them; those that overlap are one."""
    docs = np.searchsorted(first, anchors, "right") - 1
    lo, hi = np.maximum(anchors - reach + 1, first[docs]), np.minimum(anchors + reach, first[docs + 1])
    enough = np.searchsorted(at, hi) - np.searchsorted(at, lo) >= need
    docs, lo, hi = docs[enough], lo[enough], hi[enough]
    cuts = np.flatnonzero((docs[1:] != docs[:-1]) | (lo[1:] >= hi[:-1])) + 1
    if len(docs):
        begins, lasts = np.append(0, cuts), np.append(cuts, len(docs)) - 1
        yield from zip(docs[begins].tolist(), (lo[begins] - first[docs[begins]]).tolist(), (hi[lasts] - first[docs[lasts]]).tolist())


def _full(places: dict[bytes, list[int]], words: list[bytes], x: int, y: int, need: int, width: int) -> Iterator[int]:
    """The diagonals from which, ``width`` further ones included, words x to y of the document have at least ``need`` places of a template."""
    pairs = sorted((p - at, at) for p in range(x, y) for at in places.get(words[p], ()))
    held: dict[int, int] = {}
    z, before = 0, None
    for diagonal, at in pairs:
        while z < len(pairs) and pairs[z][0] <= diagonal + width:
            held[pairs[z][1]] = held.get(pairs[z][1], 0) + 1
            z += 1
        if diagonal != before and len(held) >= need:
            yield diagonal
        before = diagonal
        held[at] -= 1
        if not held[at]:
            del held[at]


def _near(diagonals: list[int], band: int) -> list[tuple[int, int]]:
    """Ranges of sorted diagonals, none with the next over ``band`` away and none wider than DRIFT bands; those of a wider chain overlap, so that any narrower part of it is in one."""
    out: list[tuple[int, int]] = []
    j = 0
    for i, x in enumerate(diagonals):
        j = max(i, j)
        while j + 1 < len(diagonals) and diagonals[j + 1] - diagonals[j] <= band and diagonals[j + 1] - x <= DRIFT * band:
            j += 1
        if not out or diagonals[j] > out[-1][1]:
            out.append((x, diagonals[j]))
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, band: int = BAND, least: float = LEAST) -> DataFrame:
    """(doc_id, license, matched_words, template_words, coverage, first_word, end_word): a row for each match."""
    small_batches(docs.sparkSession)
    index = TemplateIndex(templates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(matches(index, b.column(1), band, least))
            cols = list(zip(*rows)) or [()] * 6
            ids = b.column(0).take(pa.array(cols[0], pa.int64()))
            counts = [pa.array(c, pa.int64()) for c in cols[2:]]
            coverage = pa.array([m / n for m, n in zip(cols[2], cols[3])], pa.float64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.string()), counts[0], counts[1], coverage, counts[2], counts[3]], ["doc_id", "license", "matched_words", "template_words", "coverage", "first_word", "end_word"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(ft.released(run), f"doc_id {kind}, license string, matched_words long, template_words long, coverage double, first_word long, end_word long")
