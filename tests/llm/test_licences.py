"""Automaton against substring search, phrases and labels against a plain scan."""

import random

from weftline.llm import licences


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(40):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
        automaton = licences.Automaton(sequences)
        stream = [rng.randrange(4) for _ in range(40)]
        for i, (length, state) in enumerate(automaton.matches(stream)):
            occurs = lambda k: {(n, e) for n, s in enumerate(sequences) for e in range(k - 1, len(s)) if s[e - k + 1:e + 1] == stream[i - k + 1:i + 1]}
            best = max((k for k in range(1, i + 2) if occurs(k)), default=0)
            assert length == best
            if best:
                assert set(automaton.ends[state]) == occurs(best)


def plain(text):
    words, found = licences.split_words(text or ""), []
    for phrase, label in licences.PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


CASES = [
    None, "", " ,; ", "cc by", "Licensed under CC BY-NC 4.0.", "cc by cc by cc-by! all rights reserved",
    "ALL  RIGHTS\nRESERVED é all rights Reserved", "General public licence general public license version 3", "cc\x00by über cc, by",
    "x " * 3000 + "This work is licensed under the GNU General Public License, version 3." + " y" * 3000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software",
    licences.TEMPLATES[2][1].replace("free of charge", "gratis and freely"), "the mit license of the software", "all rights rights reserved",
]


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(None, CASES[4], "y"), (3, CASES[5], "z")], "doc_id long, text string, labels string")
    rows = licences.scan(docs).collect()
    assert len(rows) == len(CASES) + 2
    for r in rows:
        text = CASES[4] if r.doc_id is None else CASES[r.doc_id]
        if (r.doc_id, r.n_words) == (3, 9):
            text = CASES[5]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in rows if r.doc_id not in (None, 3)}
    assert labels[4] == "cc-by,cc-by-nc" and labels[9] == "gpl,gpl-3.0" and labels[11] == "mit" and labels[12] == ""
    assert licences.scan(docs.limit(0)).count() == 0
