"""Licence scan by a generalised suffix automaton of licence words.

The automaton holds every word sequence that occurs in a template. Streaming a text
through it gives, at each word, the longest match that ends there. Stretches in which no
two neighbouring words follow each other in any template cannot match and are skipped.
Maximal matches of LONG words or more are laid on the templates they occur in and chained:
matches of one template join while they advance in both text and template and leave no
more than GAP words between them. A chain that covers MOST of a template gives its label.

Three fixed phrases are reported at every place where their words stand consecutively.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

# fixed phrases and labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# openings and core sentences of public licences, as published
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
LONG, GAP, MOST = 3, 3, 0.7

_WORD_BYTES = np.full(256, 32, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _WORD_BYTES[_b] = _b
    elif 65 <= _b <= 90:
        _WORD_BYTES[_b] = _b + 32


def words(text) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): A-Z lowered; words are runs of digits, letters and characters beyond ASCII."""
    clean = pc.fill_null(text, "")
    _, starts, data = clean.buffers()
    ends = np.frombuffer(starts, np.int32)[clean.offset:clean.offset + len(clean) + 1] if len(clean) else np.zeros(1, np.int32)
    plain = _WORD_BYTES[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]] if data and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    array = pa.StringArray.from_buffers(len(clean), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(plain))
    return common.words(array)


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton:
    """Generalised suffix automaton over word numbers, with the places of each state."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[set] = [set()]
        for name, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((name, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _clone(self, state: int, length: int, ends: list) -> int:
        self.next.append(dict(self.next[state])), self.link.append(self.link[state]), self.length.append(length), ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:  # known from an earlier sequence
            there = self.next[last][word]
            if self.length[there] == self.length[last] + 1:
                return there
            twin = self._clone(there, self.length[last] + 1, ends)
            self.link[there] = twin
            while last >= 0 and self.next[last].get(word) == there:
                self.next[last][word] = twin
                last = self.link[last]
            return twin
        self.next.append({}), self.link.append(0), self.length.append(self.length[last] + 1), ends.append(set())
        new = len(self.next) - 1
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][word]
            if self.length[there] == self.length[last] + 1:
                self.link[new] = there
            else:
                twin = self._clone(there, self.length[last] + 1, ends)
                self.link[there] = self.link[new] = twin
                while last >= 0 and self.next[last].get(word) == there:
                    self.next[last][word] = twin
                    last = self.link[last]
        return new

    def matches(self, stream: list[int]):
        """Matching statistics: (length, state) of the longest match ending at each word."""
        state = length = 0
        for word in stream:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield length, state


def build(templates=TEMPLATES, phrases=PHRASES) -> dict:
    """Automaton, vocabulary and phrase places; small and fixed, so it travels with the plan."""
    sequences = [split_words(t) for t in phrases] + [split_words(t) for _, t in templates]
    vocabulary = sorted({w for s in sequences for w in s})
    number = {w: i for i, w in enumerate(vocabulary)}
    coded = [[number[w] for w in s] for s in sequences]
    automaton = Automaton(coded)
    said = {}
    for p in range(len(phrases)):
        state = 0
        for word in coded[p]:
            state = automaton.next[state][word]
        said[state] = (p, len(coded[p]))
    spoken = []  # per state the phrases that end wherever it does
    for state in range(len(automaton.next)):
        up, found = state, []
        while up > 0:
            if up in said:
                found.append(said[up])
            up = automaton.link[up]
        spoken.append(found)
    bigrams = np.unique([a * len(vocabulary) + b for s in coded for a, b in zip(s, s[1:])])
    return {"automaton": automaton, "vocabulary": vocabulary, "spoken": spoken, "bigrams": bigrams, "sizes": [len(s) for s in coded], "phrases": list(phrases.values()), "labels": [n for n, _ in templates]}


def _chained(hits: list[tuple[int, int, int, int]]) -> int:
    """Most template words covered by one chain of (text start, template start, words) hits."""
    best, ends = 0, []  # ends: (text end, template end, covered)
    for at, start, size in sorted(hits):
        covered = size
        for text_end, end, had in ends:
            overlap = max(0, text_end - at, end - start)
            if 0 <= at - text_end + overlap <= GAP + overlap and start - end + overlap >= 0 and start - end <= GAP and size > overlap:
                covered = max(covered, had + size - overlap)
        ends = [e for e in ends if e[0] >= at - GAP] + [(at + size, start + size, covered)]
        best = max(best, covered)
    return best


def scan_words(model: dict, codes: np.ndarray, start: int) -> tuple[list, list]:
    """Phrase places and template hits of one stretch of word numbers that begins at `start`."""
    automaton, n_phrases = model["automaton"], len(model["phrases"])
    places, hits, stream = [], [], codes.tolist()
    stats = list(automaton.matches(stream))
    for i, (length, state) in enumerate(stats):
        for phrase, size in model["spoken"][state]:
            if length >= size:
                places.append((phrase, start + i - size + 1))
        longer = i + 1 < len(stats) and stats[i + 1][0] == length + 1
        if length >= LONG and not longer:
            for name, end in automaton.ends[state]:
                if name >= n_phrases:
                    hits.append((name, start + i - length + 1, end - length + 1, length))
    return places, hits


def _scanning(model: dict):
    def run(batches):
        vocabulary, n_phrases = pa.array(model["vocabulary"], pa.string()), len(model["phrases"])
        for part in common.slices(batches, "text"):
            offsets, flat = words(part.column("text"))
            codes = pc.fill_null(pc.index_in(flat, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            pair = np.zeros(len(codes) + 1, bool)  # pair[i]: words i-1 and i follow each other in a template
            if len(codes) > 1:
                both = (codes[:-1] >= 0) & (codes[1:] >= 0) & (row[:-1] == row[1:])
                pair[1:-1] = both & np.isin(codes[:-1] * len(vocabulary) + codes[1:], model["bigrams"])
            edge = np.diff(pair.astype(np.int8))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            places, hits = [[] for _ in range(part.num_rows)], [{} for _ in range(part.num_rows)]
            for a, b in zip(first.tolist(), last.tolist()):
                if b - a < 1:
                    continue
                r = int(row[a])
                found, near = scan_words(model, codes[a:b + 1], a - int(offsets[r]))
                places[r] += found
                for name, at, start, size in near:
                    hits[r].setdefault(name, []).append((at, start, size))
            out = []
            for r in range(part.num_rows):
                base = {model["phrases"][p] for p, _ in places[r]}
                at, score, own = [i for _, i in places[r]], 1.0 if places[r] else 0.0, set()
                for name, found in hits[r].items():
                    share = min(1.0, _chained(found) / model["sizes"][name])
                    score = max(score, share)
                    if share >= MOST:
                        own.add(model["labels"][name - n_phrases])
                out.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score))
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    score is the largest share of a template covered by one chain, 1 where a phrase stands.
    Null and empty texts: no words, no places, empty labels, score 0. Extra columns are ignored.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(
        _scanning(build(templates, phrases)),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
