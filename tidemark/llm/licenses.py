"""License scans: an exact set-similarity join between text blocks and license templates.

A template T matches a block B when |T n B| >= theta * |T| over their distinct words (containment of the template).
The blocks of a text for T are all its windows of consecutive words, a quarter longer than T, so a template is found in
any layout of lines, and words that stand far apart don't add up. Every word of the templates has a global rank: how many
documents hold it, rarest first. Sorted by it, a window can only match if it holds one of the first
|T| - ceil(theta |T|) + 1 words of T (prefix filter), so only windows around those are looked at. Such a stretch of windows is
put in the global order too: from its first word shared with T on, both T and the stretch must have enough words left
(positional filter), and the stretch must have enough words of T at all (length filter). What is left is counted exactly,
word by word. So every window that meets the threshold is found, for every template.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM, id_and_text, raw_texts, tidy

THETA = 0.8
# Well-known license texts, by label, a paragraph or a notice each. A parameter of the functions below.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
PHRASES = (((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl"))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM).split()


def document_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many of all documents each of these words stands. The result is as small as the list of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                seen.update(words.intersection(words_of(raw)))
        yield pa.record_batch([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows}


class Matcher:
    """The inverted index of template prefixes, and the filters."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], theta: float):
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        self.sets: list[tuple[str, list[bytes], int, int]] = []  # label, words by rank, words needed, words of a window
        vocabulary = sorted({w for _, text in templates for w in words_of(text.encode())}, key=lambda w: (frequency.get(w, 0), w))
        self.words, self.rank = vocabulary, {w: k for k, w in enumerate(vocabulary)}
        self.pruned = 0  # stretches that the positional filter left out
        for label, text in templates:
            words = words_of(text.encode())
            tokens = sorted(set(words), key=self.rank.__getitem__)
            if not tokens:
                continue
            need = max(1, math.ceil(theta * len(tokens) - 1e-9))
            for place, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefixes.setdefault(token, []).append((len(self.sets), place))
            self.sets.append((label, tokens, need, len(words) + len(words) // 4))
        self.keys = frozenset(self.prefixes)
        self.numbers = [{w: k for k, w in enumerate(tokens)} for _, tokens, _, _ in self.sets]

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, highest containment) of every run of overlapping windows that meet a template."""
        if self.keys.isdisjoint(words):
            return []
        near: dict[int, list[int]] = {}  # places of prefix words, by template
        for at, w in enumerate(words):
            for t, _ in self.prefixes.get(w, ()):
                near.setdefault(t, []).append(at)
        ranks = np.fromiter((self.rank.get(w, -1) for w in words), np.int64, len(words))
        found = []
        for t, places in near.items():
            label, tokens, need, width = self.sets[t]
            stretches: list[list[int]] = []
            for p in places:  # a window that matches holds one of these places
                if stretches and p - width + 1 <= stretches[-1][1]:
                    stretches[-1][1] = p + width
                    stretches[-1][2] = min(stretches[-1][2], ranks[p])
                else:
                    stretches.append([max(0, p - width + 1), p + width, ranks[p]])
            number = self.numbers[t]
            for low, high, first in stretches:
                if not self._enough(ranks[low:high], int(first), t):
                    self.pruned += 1
                    continue
                hits = [(k, number[w]) for k, w in enumerate(words[low:high], low) if w in number]
                if len(hits) >= need:
                    found += [(label, a, b, best / len(tokens)) for a, b, best in _runs(hits, need, width)]
        return found

    def _enough(self, block: np.ndarray, first: int, t: int) -> bool:
        """Positional filter: what template and block can share from their first shared word on, by rank. Words before it in
        either are missing from the other."""
        _, tokens, need, _ = self.sets[t]
        left = len(np.unique(block[block >= first]))
        return min(left, len(tokens) - self.numbers[t][self.words[first]]) >= need


def _runs(hits: list[tuple[int, int]], need: int, width: int) -> list[tuple[int, int, int]]:
    """(first, last, most distinct) of runs of overlapping windows of `width` words with `need` distinct hits or more."""
    runs: list[list[int]] = []
    held: dict[int, int] = {}
    first = 0
    for at, k in hits:
        held[k] = held.get(k, 0) + 1
        while hits[first][0] <= at - width:
            old = hits[first][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            first += 1
        if len(held) >= need:
            if runs and hits[first][0] <= runs[-1][1]:
                runs[-1][1:] = [at, max(runs[-1][2], len(held))]
            else:
                runs.append([hits[first][0], at, len(held)])
    return [tuple(r) for r in runs]


def phrase_starts(words: list[bytes]) -> list[tuple[int, str]]:
    """Places where the words of a base phrase stand one after another."""
    found, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return found
        for phrase, label in PHRASES:
            start = at - len(phrase) + 1
            if start >= 0 and tuple(words[start : at + 1]) == phrase:
                found.append((start, label))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, theta: float = THETA) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    score is the highest containment of a template in a window that meets theta, else 0, and 1 where a base phrase
    stands. A null or empty text has no words, no labels (empty strings) and null places. Repeated rows give repeated
    rows, a null doc_id stays null, an empty table gives no rows; columns
    of other names play no part. The templates are a short list sent with the code.
    """
    docs = id_and_text(docs)
    words = {w for _, text in templates for w in words_of(text.encode())}
    matcher = Matcher(list(templates), document_frequencies(docs, words), theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in _SCAN.names[1:]}
            for raw in raw_texts(batch.column(1)):
                all_words = words_of(raw)
                starts = phrase_starts(all_words)
                base = {label for _, label in starts}
                labels, score = set(base), 1.0 if base else 0.0
                for label, _, _, share in matcher.matches(all_words):
                    labels.add(label)
                    score = max(score, share)
                places = [p for p, _ in starts]
                values = (len(all_words), len(starts), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            yield pa.record_batch([batch.column(0), *(pa.array(v, f.type) for v, f in zip(out.values(), list(_SCAN)[1:], strict=True))], schema=_SCAN)

    return docs.mapInArrow(tidy(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


_SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def license_blocks(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, theta: float = THETA) -> DataFrame:
    """The join itself: doc_id, block (its text), first_word, last_word, label, containment of every run of windows that
    meets theta, for every template. Texts without words give no rows; repeated rows give repeated rows, a null doc_id stays
    null, an empty table gives no rows."""
    docs = id_and_text(docs)
    words = {w for _, text in templates for w in words_of(text.encode())}
    matcher = Matcher(list(templates), document_frequencies(docs, words), theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                found = matcher.matches(words_of(raw))
                places = [m.span() for m in _WORD.finditer(raw)] if found else []
                rows += [(doc_id, raw[places[a][0] : places[b][1]].decode(), a, b, label, share) for label, a, b, share in found]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "block", "first_word", "last_word", "label", "containment"])

    return docs.mapInArrow(tidy(run), "doc_id long, block string, first_word long, last_word long, label string, containment double")
