"""License scans by an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency over the whole corpus, rare ones first. A template of n distinct tokens that a block
contains to the threshold t shares one of its first n - ceil(t n) + 1 tokens with it (prefix filter), the block has at
least ceil(t n) distinct tokens (length filter), and behind the first shared token enough of the template is left
(positional filter); what passes is counted exactly. An index from prefix tokens to templates gives each block its candidates, so only
blocks with a rare license word are looked at closely, and every block that reaches the threshold is found. Templates are
few and fixed, so they go to every task.

Blocks are whole lines and whole paragraphs, of any length; templates are paragraphs of license texts and notices. Words are runs of
ASCII letters and digits (A-Z as a-z) and of characters beyond ASCII. Null texts count as empty: no words, no labels,
score 0. Rows given twice are scanned twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, lowered, text_words, word_hashes, word_spans

#: Labels by phrase: places where these words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Paragraphs of license texts and of notices, by label. The wording of the licenses.
TEMPLATES = {
    "mit-notice": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc-notice": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "apache-notice": [
        "Licensed under the Apache License, Version 2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-notice": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-notice": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd-notice": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-notice": [
        "This Source Code Form is subject to the terms of the Mozilla Public License",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense-notice": ["This is free and unencumbered software released into the public domain."],
}
THRESHOLD = 0.85


class Vocabulary:
    """Numbers of the words of phrases and templates, by hash."""

    def __init__(self) -> None:
        words = sorted({w for x in [*PHRASES, *(y for ys in TEMPLATES.values() for y in ys)] for w in split(x)})
        hashes = np.concatenate([text_words(w, ALNUM) for w in words])
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.words = hashes[order], order, words
        self.number = {w: k for k, w in enumerate(words)}

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)


def split(text: str) -> list[str]:
    data = lowered(text)
    return [data[a:b].tobytes().decode() for a, b in zip(*word_spans(data, ALNUM), strict=True)]


def token_frequencies(texts: DataFrame) -> dict[str, int]:
    """How often each word of the vocabulary occurs in a table (text). At most one number a word comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        total = np.zeros(len(known.words), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = known.look_up(text_words(text, ALNUM))
                total += np.bincount(found[found >= 0], minlength=len(total))
        yield pa.record_batch([pa.array(known.words), pa.array(total)], names=["word", "n"])

    return {r[0]: r[1] for r in texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n")).collect()}


class Templates:
    """The templates with an index from each prefix token to (template, its place in the global order of the template's tokens)."""

    def __init__(self, known: Vocabulary, frequency: dict[str, int], threshold: float):
        self.labels: list[str] = []
        self.tokens: list[list[int]] = []
        self.needs: list[int] = []
        self.index: dict[int, list[tuple[int, int]]] = {}
        for label, texts in TEMPLATES.items():
            for text in texts:
                words = sorted(set(split(text)), key=lambda w: (frequency.get(w, 0), w))
                need = math.ceil(threshold * len(words) - 1e-9)
                tokens = [known.number[w] for w in words]
                for place, token in enumerate(tokens[: len(words) - need + 1]):
                    self.index.setdefault(token, []).append((len(self.tokens), place))
                self.labels.append(label)
                self.tokens.append(tokens)
                self.needs.append(need)

    def contained(self, block: set[int], size: int) -> Iterator[tuple[str, float]]:
        """Label and share of the tokens of each template that a block holds to the threshold. block: its vocabulary words of ``size`` distinct words."""
        first: dict[int, int] = {}  # the first prefix token of each candidate
        for token in block & self.index.keys():
            for x, place in self.index[token]:
                first[x] = min(place, first.get(x, place))
        for x, place in first.items():
            tokens, need = self.tokens[x], self.needs[x]
            if size < need or len(tokens) - place < need:
                continue
            both = sum(t in block for t in tokens[place:])
            if both >= need:
                yield self.labels[x], both / len(tokens)


def blocks(data: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Lines and paragraphs as ranges of words. first: the byte at which each word begins."""
    newline = np.flatnonzero(data == 10)
    line = np.concatenate([[0], np.searchsorted(first, newline), [len(first)]])
    # a paragraph ends where a line has no words
    empty = np.flatnonzero(line[1:] == line[:-1])
    paragraph = np.concatenate([[0], line[empty], [len(first)]])
    seen = set()
    for bounds in (line, paragraph):
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi > lo and (lo, hi) not in seen:
                seen.add((lo, hi))
                yield lo, hi


SCANNED = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, phrase places and labels, template labels, and the greatest containment found (1 for a phrase)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequency = token_frequencies(rows.select("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        phrases = [(label, np.array([known.number[w] for w in phrase.split(" ")])) for phrase, label in PHRASES.items()]
        templates = Templates(known, frequency, threshold)
        rare = np.zeros(len(known.words) + 1, bool)  # the last entry is for other words, number -1
        rare[list(templates.index)] = True
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = lowered(text or "")
                first, end = word_spans(data, ALNUM)
                hashes = word_hashes(data, first, end)
                numbers = known.look_up(hashes)
                places, base = [], set()
                for label, phrase in phrases:
                    at = np.flatnonzero(numbers == phrase[0])
                    at = at[at + len(phrase) <= len(numbers)]
                    for k in range(1, len(phrase)):
                        at = at[numbers[at + k] == phrase[k]]
                    if len(at):
                        base.add(label)
                        places += at.tolist()
                labels, score = set(base), 1.0 if base else 0.0
                hits = np.flatnonzero(rare[numbers])
                if len(hits):
                    for lo, hi in blocks(data, first):
                        if np.searchsorted(hits, hi) > np.searchsorted(hits, lo):
                            inside = set(numbers[lo:hi].tolist()) - {-1}
                            size = len(np.unique(hashes[lo:hi]))
                            for label, share in templates.contained(inside, size):
                                labels.add(label)
                                score = max(score, share)
                ends = (min(places), max(places)) if places else (None, None)
                out.append((doc, len(first), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            types = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[x.split(" ")[0] for x in SCANNED.split(", ")])

    return rows.mapInArrow(scan, SCANNED)
