"""Licence scans with a positional index of rare words.

The templates' words are indexed by (template, position). A text's own licence words are looked up from the rarest on
(highest inverse document frequency, counted over the whole corpus), until every template whose mandatory words the
text has got its share of lookups. Postings are intersected by relative position: a word at place i of the text and
place j of a template votes for the alignment i - j. An alignment with half of what was looked up is verified: the
template's mandatory phrases must stand where the alignment puts them, give or take a word, and its coverage is the
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, texts

#: Phrases and labels of the contract (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label: (opening words of the notice, mandatory phrases). The notices' public wording.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "apache-2.0-notice": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license", "may not use this file except in compliance")),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "free software foundation")),
    "lgpl": ("licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    "agpl": ("licensed under the gnu affero general public license", ("gnu affero general public license",)),
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    "released-mit": ("released under the mit license", ("mit license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-long": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    "all-rights-reserved": ("copyright all rights reserved", ("all rights reserved",)),
}
#: Rare words looked up for each template that a text may hold, and the share of a template's words that must be there.
LOOKUPS, COVERED = 4, 0.6
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

VOCABULARY = sorted({w for text, _ in TEMPLATES.values() for w in text.split()} | {w for p in BASE for w in p.split()})


def word_starts(text: bytes) -> np.ndarray:
    """Byte places at which the words of a lowered text start."""
    inside = _WORD_BYTE[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(inside & ~np.r_[False, inside[:-1]])


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many texts each licence word occurs, and the number of texts: one pass, VOCABULARY numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wanted = Counter(), 0, {w.encode() for w in VOCABULARY}
        for batch in batches:
            for text in texts(batch):
                n += 1
                held.update(wanted.intersection(WORD.findall(text.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in held)]), pa.array([n, *held.values()], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return {w: n for w, n in found.items() if w}, found.get("", 0)


class Index:
    """Postings of the templates' words, rarest first."""

    def __init__(self, frequency: dict[str, int], total: int):
        self.idf = {w.encode(): math.log((1 + total) / (1 + frequency.get(w, 0))) for w in VOCABULARY}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.words = {label: text.encode().split() for label, (text, _) in TEMPLATES.items()}
        self.keys = {label: [p.encode().split() for p in phrases] for label, (_, phrases) in TEMPLATES.items()}
        for label, words in self.words.items():
            for at, word in enumerate(words):
                self.postings[word].append((label, at))
        self.base = [(p.encode().split(), label) for p, label in BASE.items()]
        self.must = {label: {w for k in keys for w in k} for label, keys in self.keys.items()}
        self.seek = {w.encode() for w in VOCABULARY}
        #: a text without any of these has neither a base phrase nor a mandatory phrase
        self.marks = {max(phrase, key=len) for phrase, _ in self.base} | {max(keys[0], key=len) for keys in self.keys.values()}

    def alignments(self, words: list[bytes], hits: list[int]) -> dict[str, list[int]]:
        """For each template that the text may hold, the places where half of its looked-up weight puts its start."""
        held: dict[bytes, list[int]] = defaultdict(list)
        for i in hits:
            held[words[i]].append(i)
        wanted = {label: LOOKUPS for label, must in self.must.items() if must <= held.keys()}
        weight: dict[str, float] = defaultdict(float)
        votes: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for word in sorted(held, key=lambda w: (-self.idf[w], w)):
            if not any(wanted.values()):
                break
            for label in {label for label, _ in self.postings.get(word, ()) if wanted.get(label)}:
                wanted[label] -= 1
                weight[label] += self.idf[word]
                for shift in {i - at for of, at in self.postings[word] if of == label for i in held[word]}:
                    votes[label][shift] += self.idf[word]
        return {label: [k for k, w in shifts.items() if 2 * (w + shifts.get(k - 1, 0.0) + shifts.get(k + 1, 0.0)) >= weight[label]] for label, shifts in votes.items()}

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
        """n_words, n_base, first and last base place, base labels, the method's labels, score."""
        text = text.lower()
        starts = word_starts(text)
        n = len(starts)
        if not any(mark in text for mark in self.marks):
            return n, 0, None, None, set(), set(), 0.0
        words = WORD.findall(text)
        hits = [i for i, w in enumerate(words) if w in self.seek]
        n_base, places, labels = 0, [], set()
        for phrase, label in self.base:
            for i in hits:
                if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase:
                    n_base += 1
                    places.append(i)
                    labels.add(label)
        more, score = set(), 1.0 if labels else 0.0
        for label, shifts in self.alignments(words, hits).items():
            template = self.words[label]
            for shift in shifts:
                part = words[max(0, shift - 1) : max(0, shift + len(template) + 1)]
                if all(any(part[k : k + len(key)] == key for k in range(len(part) - len(key) + 1)) for key in self.keys[label]):
                    same = sum((Counter(part) & Counter(template)).values()) / len(template)
                    if same >= COVERED:
                        more.add(label)
                        score = max(score, same)
        return n, n_base, min(places, default=None), max(places, default=None), labels, more, score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text counts as empty: no words, no labels ('' for both label columns), null places, score 0. Null ids and
    repeated rows are kept as they are; an empty table gives an empty result; other columns are ignored. Two narrow
    passes; between them, one number for each licence word reaches the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    frequency, total = document_frequencies(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, total)
        for batch in batches:
            found = [index.scan(t) for t in texts(batch)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            base = pa.array([",".join(sorted(f[4])) for f in found], pa.string())
            every = pa.array([",".join(sorted(f[4] | f[5])) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, base, every, pa.array([f[6] for f in found], pa.float64())], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
