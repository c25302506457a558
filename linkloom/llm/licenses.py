"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds the token sequences of all templates. A text streams through it once and yields matching statistics: the
longest run of template tokens that ends at each word. Maximal runs of at least `shortest` words are chained, template by
template, as long as they go on in order within `gap` words; a chain covers spans of its template, and a template of which
enough is covered gives its label. Texts are read in one pass; nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, lean

# Phrases of the contract, and notices of the licences.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, lower-cased A-Z: digits, letters a-z and what is beyond ASCII."""
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton over token sequences; each state knows where its runs end in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for which, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].setdefault(which, []).append(at)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            for which, at in self.ends[s].items():
                above = self.ends[self.link[s]].setdefault(which, [])
                above += at
        for ends in self.ends:
            for which in ends:
                ends[which] = sorted(set(ends[which]))

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A state for the runs that reach q from p, apart from q's longer ones."""
        new = self._state(self.length[p] + 1)
        self.next[new], self.link[new], self.link[q] = dict(self.next[q]), self.link[q], new
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def statistics(self, tokens) -> Iterator[tuple[int, int]]:
        """For each token the length of the longest run that ends there, and its state."""
        state, n = 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(t)
            state, n = (to, n + 1) if to is not None else (0, 0)
            yield n, state

    def maximal(self, tokens, shortest: int) -> Iterator[tuple[int, int, int]]:
        """(first, end, state) of the runs of at least `shortest` tokens that the next token does not go on."""
        before = (0, 0)
        k = -1
        for k, (n, state) in enumerate(self.statistics(tokens)):
            if before[0] >= shortest and n <= before[0]:
                yield k - before[0], k, before[1]
            before = (n, state)
        if before[0] >= shortest:
            yield k + 1 - before[0], k + 1, before[1]


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, shortest: int = 4, gap: int = 12, least: float = 0.5):
        sequences = [words_of(text.encode()) for _, text in templates]
        phrase_words = [(p.encode().split(), label) for p, label in phrases]
        known = dict.fromkeys(w for x in [*sequences, *(p for p, _ in phrase_words)] for w in x)
        self.ids = {w: k for k, w in enumerate(known)}
        self.labels, self.sizes = [label for label, _ in templates], [len(x) for x in sequences]
        self.automaton = Automaton([[self.ids[w] for w in x] for x in sequences])
        self.phrases = [([self.ids[w] for w in p], label) for p, label in phrase_words]
        self.shortest, self.gap, self.least = shortest, gap, least

    def chains(self, runs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word, end, template words covered) of each chain."""
        open_: dict[int, list[int]] = {}  # template -> first, end, template position reached, covered
        for a, b, state in runs:
            for which, ends in self.automaton.ends[state].items():
                chain = open_.get(which)
                if chain is not None and a - chain[1] <= self.gap:
                    # A run that overlaps the one before it counts only from there.
                    cut = max(0, chain[1] - a)
                    reach = next((e + 1 for e in ends if e + 1 - (b - a) + cut >= chain[2]), None)
                    if reach is not None and b > chain[1]:
                        chain[1], chain[2], chain[3] = b, reach, chain[3] + b - a - cut
                        continue
                    if chain[3] >= b - a:
                        continue
                if chain is not None:
                    yield which, chain[0], chain[1], chain[3]
                open_[which] = [a, b, ends[0] + 1, b - a]
        for which, chain in open_.items():
            yield which, chain[0], chain[1], chain[3]

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        places, base = [], set()
        for phrase, label in self.phrases:
            if len(ids) >= len(phrase):
                hit = np.ones(len(ids) - len(phrase) + 1, bool)
                for k, w in enumerate(phrase):
                    hit &= ids[k : k + len(hit)] == w
                at = np.flatnonzero(hit)
                if len(at):
                    places.append(at)
                    base.add(label)
        labels, score = set(base), 0.0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        runs = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # between words that no template has
            if b - a >= self.shortest:
                runs += [(a + x, a + y, s) for x, y, s in self.automaton.maximal(ids[a:b].tolist(), self.shortest)]
        for which, _, _, covered in self.chains(runs):
            share = min(1.0, covered / self.sizes[which])
            score = max(score, share)
            if share >= self.least:
                labels.add(self.labels[which])
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        first, last = (int(at.min()), int(at.max())) if len(at) else (None, None)
        return len(words), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


@functools.cache
def _scanner(*options) -> Scanner:
    return Scanner(shortest=options[0], gap=options[1], least=options[2])


FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 4, gap: int = 12, least: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are those where a phrase's words stand consecutively; labels adds those of templates of which a chain covers
    at least the share `least`; score is the largest share covered. A null text counts as empty: no words, no labels, score 0.
    Repeated rows each give a row; other columns are not read; an empty table gives an empty result."""

    def run(batches):
        scanner = _scanner(shortest, gap, least)
        yield from batched(((i, *scanner.scan(x)) for b in batches for i, x in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True)), FOUND)

    source = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
