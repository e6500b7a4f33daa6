"""License scans with a positional index of rare words.

The templates' words are indexed by template and position. A file's licence words are ranked by inverse document
frequency in the corpus and looked up, rarest first. A template is found where SHARE of its words stand, so
one word at least of its rarest words that together are more than the rest is in the file: only
those have postings, and the lookup rejects nothing that the comparison would accept. Each hit puts a template at a relative
position. Places (within a tolerance for edits) are compared in the order of the words that agree on
them: SHARE of all the template's words must be there and its mandatory key phrase among them. Three plain
phrases (the base) are labels of their own.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, texts_of

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening or characteristic passages of common licences, with a phrase that must be there.
TEMPLATES = {
    "mit-text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission is hereby granted free of charge"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission to use copy modify"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "redistribution and use in source and binary forms"),
    "apache-notice": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "licensed under the apache license"),
    "apache-short": ("Licensed under the Apache License, Version 2.0.", "apache license version 2 0"),
    "gpl-notice": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public license"),
    "gpl-short": ("This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3"),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    "agpl": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0"),
    "cc0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "dedicated all copyright and related and neighboring rights"),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "free and unencumbered software released into the public domain"),
    "mit-short": ("Released under the MIT License.", "released under the mit license"),
    "reserved": ("Copyright. All rights reserved. No part may be reproduced without permission.", "all rights reserved"),
}

#: Of each template: share of its words that must match; drift of relative positions for an edit.
SHARE, DRIFT = 0.7, 2

KEEP = bytes(c if chr(c).isdigit() and c < 128 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    """Words of digits, letters and all that isn't ASCII, A-Z lower-cased."""
    return text.translate(KEEP).split()


def phrase_starts(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    """All places where the phrase's words stand consecutively."""
    out, at, last = [], -1, phrase[-1]
    try:
        while True:
            at = words.index(last, at + 1)
            start = at - len(phrase) + 1
            if start >= 0 and tuple(words[start : at + 1]) == phrase:
                out.append(start)
    except ValueError:
        return out


def vocabulary() -> list[str]:
    return sorted({w.decode() for text, _ in TEMPLATES.values() for w in words_of(text.encode())})


def frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many texts each word of the templates occurs, over all texts (as many numbers as templates have words)."""
    known = [w.encode() for w in vocabulary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        vocab = set(known)
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                for text in texts:
                    counts.update(vocab.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return {r["word"]: r["n"] for r in id_and_text(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Postings of the templates' words, by inverse document frequency, and the scan of one file."""

    def __init__(self, frequency: dict[str, int]):
        self.words = {k: words_of(text.encode()) for k, (text, _) in TEMPLATES.items()}
        self.keys = {k: tuple(words_of(key.encode())) for k, (_, key) in TEMPLATES.items()}
        self.counts = {k: Counter(words) for k, words in self.words.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            rare, covered = set(), 0
            for word in sorted(self.counts[name], key=lambda w: (frequency.get(w.decode(), 0), w)):
                if covered > len(words) - SHARE * len(words):
                    break
                rare.add(word)
                covered += self.counts[name][word]
            for at, word in enumerate(words):
                if word in rare:
                    self.postings[word].append((name, at))
        self.rank = {w: i for i, w in enumerate(sorted(self.postings, key=lambda w: (frequency.get(w.decode(), 0), w)))}
        self.base = {tuple(p.encode().split()): label for p, label in BASE.items()}

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        there = set(words)
        starts, base = [], set()
        if b"license" in there:
            for phrase, label in self.base.items():
                if there.issuperset(phrase) and (found := phrase_starts(words, phrase)):
                    starts += found
                    base.add(label)
        labels, score = self.templates(words, there)
        if base:
            score = max(score, 1.0)
        return len(starts), min(starts, default=None), max(starts, default=None), base, base | labels, score

    def templates(self, words: list[bytes], there: set[bytes]) -> tuple[set[str], float]:
        rare = sorted(there.intersection(self.postings), key=self.rank.__getitem__)
        wanted = {n for w in rare for n, _ in self.postings[w] if there.issuperset(self.keys[n])}
        labels, best = set(), 0.0
        if not wanted:
            return labels, best
        at_word: dict[bytes, list[int]] = {w: [] for w in rare}
        for i, word in enumerate(words):
            if word in at_word:
                at_word[word].append(i)
        places: dict[str, dict[int, set[bytes]]] = {n: defaultdict(set) for n in wanted}
        for word in rare:
            for name, at in self.postings[word]:
                if name in wanted:
                    for i in at_word[word]:
                        for drift in range(-DRIFT, DRIFT + 1):
                            places[name][i - at + drift].add(word)
        for name, agreed in places.items():
            top = 0.0
            for at in sorted(agreed, key=lambda at: (-len(agreed[at]), at)):
                top = max(top, self.compared(name, words, at))
                if top == 1:
                    break
            if top >= SHARE:
                labels.add(name)
                best = max(best, top)
        return labels, best

    def compared(self, name: str, words: list[bytes], at: int) -> float:
        """The share of a template's words in the window where it would start at ``at``; 0 without its key phrase."""
        template = self.words[name]
        window = words[max(0, at - DRIFT) : max(0, at + len(template) + DRIFT)]
        share = min(1.0, sum((Counter(window) & self.counts[name]).values()) / len(template))
        return share if share >= SHARE and phrase_starts(window, self.keys[name]) else 0.0


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row for each row of ``docs``.

    score is the largest share of a found template's words (1 for a base phrase), 0 if nothing is found. Null
    and empty texts have no words, no labels ('') and null places; very long ones are scanned whole; null or repeated ids
    are scanned like others; an empty table gives an empty result; other columns are ignored."""
    frequency = frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency)
        for batch in slices(batches):
            rows: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                n, first, last, base, labels, score = index.scan(words)
                for column, value in zip(rows, (len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
