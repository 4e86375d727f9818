"""Licence scans with a generalised suffix automaton of licence tokens.

The templates' words are put into one suffix automaton (a state per class of end positions). A text
is streamed word by word; the automaton gives, at each word, the length of the longest template
substring that ends there (matching statistics). Two things are read off:

* base phrases: a phrase ends at a word exactly if its state is the current state or one of its
  suffix-link ancestors (and the match is long enough), so all places are found in the same pass;
* covered spans: for each template, matches with it of at least ``min_match`` words that cannot be
  extended in it are chained if they are at most ``max_gap`` words apart and run forward in it. A
  chain that covers ``min_cover`` of the template adds the template's label. Words that several
  templates share count for each of them: a state knows all templates and places where it ends, and
  its suffix-link ancestors those templates that match only its last words.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null text is the empty text: no
words, no labels, score 0. Very long texts are streamed with a constant state besides their words.
A null id stays null; rows that repeat an id or a text are scanned one by one and give a row each. An
empty table gives an empty result. Extra columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import words_of

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Openings and notices of public licences, as published.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


class SuffixAutomaton:
    """Suffix automaton of several token sequences; ``own`` are the (sequence, position) of prefixes that a state holds."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.own: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """Give the strings of q that end with p's strings and the token a state of their own."""
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int], number: int) -> None:
        last = 0
        for at, token in enumerate(sequence):
            there = self.next[last].get(token)
            if there is not None:
                last = there if self.length[there] == self.length[last] + 1 else self._split(last, there, token)
                self.own[last].append((number, at))
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p != -1 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
            last = new
            self.own[last].append((number, at))

    def ends(self, least: int) -> list[dict[int, list[int]]]:
        """Per state of ``least`` tokens or more: all places where it ends, by sequence, in order."""
        found: list[dict[int, list[int]]] = [{} for _ in self.length]
        for s in sorted(range(len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[s] < least:
                break
            for number, at in self.own[s]:
                found[s].setdefault(number, []).append(at)
            for places in found[s].values():
                places.sort()
            if self.link[s] > 0:
                above = found[self.link[s]]
                for number, places in found[s].items():
                    above.setdefault(number, []).extend(places)
        return found


@dataclass
class Found:
    """What a scan of one text gives. ``spans``: (first word, end, label, cover)."""

    n_words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)
    spans: list[tuple[int, int, str, float]] = field(default_factory=list)


class LicenseScanner:
    def __init__(self, templates=None, phrases=None, min_match: int = 4, max_gap: int = 6, min_cover: float = 0.5):
        templates, self.phrases = templates or TEMPLATES, phrases or BASE_PHRASES
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        texts = [(label, words_of(t)) for label, t in templates.items()]
        base = [(label, words_of(p)) for p, label in self.phrases.items()]
        self.ids: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.sizes, self.labels = [], []
        for number, (label, words) in enumerate(texts + base):
            self.automaton.add([self.ids.setdefault(w, len(self.ids)) for w in words], number)
            self.sizes.append(len(words))
            self.labels.append(label)
        self.n_templates = len(texts)
        a = self.automaton
        ends_at: dict[int, list[tuple[int, str]]] = {}
        for label, words in base:
            s = 0
            for w in words:
                s = a.next[s][self.ids[w]]
            ends_at.setdefault(s, []).append((len(words), label))
        #: per state: phrases of itself (need the length) and of its ancestors, longest state first
        self.ending: list[list[tuple[int, str]]] = []
        for s in range(len(a.length)):
            got, at = [], s
            while at > 0:
                got += ends_at.get(at, [])
                at = a.link[at]
            self.ending.append(got)

        #: per state: (template, longest match with it, where that ends in it), for the templates of the state
        #: and those that only its ancestors are in
        ends = a.ends(self.min_match)
        self.near: list[list[tuple[int, int, list[int]]]] = []
        for s in range(len(a.length)):
            seen: dict[int, tuple[int, list[int]]] = {}
            at = s
            while at > 0 and a.length[at] >= self.min_match:
                for t, places in ends[at].items():
                    if t < self.n_templates:
                        seen.setdefault(t, (a.length[at], places))
                at = a.link[at]
            self.near.append([(t, longest, places) for t, (longest, places) in seen.items()])

    def scan(self, text: str | None) -> Found:
        words = words_of(text)
        found = Found(len(words))
        for t, matches in self.matches(words, found.base).items():
            found.spans += self._chain(t, matches)
        found.spans.sort()
        return found

    def matches(self, words: list[bytes], base: list[tuple[int, str]]) -> dict[int, list[tuple[int, int, list[int]]]]:
        """Per template its long matches (end word, words, places where they end in it); phrases go to ``base``."""
        a, ids = self.automaton, self.ids
        edges, link, lengths, ending = a.next, a.link, a.length, self.ending
        state = length = 0
        running: dict[int, tuple[int, list[int]]] = {}
        long: dict[int, list[tuple[int, int, list[int]]]] = {}
        for i, w in enumerate(words):
            token = ids.get(w)
            if token is None:
                state = length = 0
            else:
                while state > 0 and token not in edges[state]:
                    state = link[state]
                    length = lengths[state]
                to = edges[state].get(token)
                state, length = (0, 0) if to is None else (to, length + 1)
            if running or length >= self.min_match:
                running = self._extend(running, state, length, i, long)
            for size, label in ending[state]:
                if size <= length:
                    base.append((i + 1 - size, label))
        self._extend(running, 0, 0, len(words), long)
        return long

    def _extend(self, running, state: int, length: int, end: int, long) -> dict[int, tuple[int, list[int]]]:
        """The templates' matches that end with this word; matches up to ``end`` that it does not extend go to ``long``."""
        now = {}
        if length >= self.min_match:
            now = {t: (min(length, longest), places) for t, longest, places in self.near[state]}
        for t, (size, places) in running.items():
            if t not in now or now[t][0] != size + 1:
                long.setdefault(t, []).append((end, size, places))
        return now

    def _chain(self, t: int, matches: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, str, float]]:
        """Spans of one template. Matches are (end word, words, places in the template), by end word.

        A match goes to the first place that adds all its words, else to the last one behind the chain.
        """
        spans, chain = [], None
        for end, size, places in matches:
            at = places[0]
            if chain:
                start, stop, last, covered = chain
                new = min(size, end - stop)
                at = next((p for p in places if p - last >= new), places[-1])
                if end - size - stop <= self.max_gap and at > last:
                    chain = (start, end, at, covered + min(new, at - last))
                    continue
                spans.append(chain)
                at = places[0]
            chain = (end - size, end, at, size)
        if chain:
            spans.append(chain)
        return [
            (start, stop, self.labels[t], covered / self.sizes[t])
            for start, stop, _, covered in spans
            if covered >= self.min_cover * self.sizes[t]
        ]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<first_word:long,end_word:long,label:string,cover:double>>"
)


def scan_licenses(docs: DataFrame, scanner: LicenseScanner | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: base places, labels, covered template spans and a score.

    ``score`` is 1.0 where a base phrase stands, else the best cover of a span, else 0.
    """
    scanner = scanner or LicenseScanner(**options)
    spans_type = pa.list_(
        pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = scanner.scan(text.as_py())
                starts = [s for s, _ in f.base]
                plain = {x for _, x in f.base}
                labels = plain | {s[2] for s in f.spans}
                rows.append((
                    doc_id, f.n_words, len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(plain)), ",".join(sorted(labels)),
                    1.0 if starts else min(1.0, max((s[3] for s in f.spans), default=0.0)),
                    [dict(zip(("first_word", "end_word", "label", "cover"), s, strict=True)) for s in f.spans],
                ))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), spans_type]
            names = [x.split()[0] for x in SCHEMA.split(", ")[:8]] + ["spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
