"""License scans by patience alignment.

A text and a template are aligned as word sequences: words that stand exactly once in both are
anchors, the longest increasing run of anchors is kept, and the gaps between are aligned in the
same way. Coverage is the share of the template's words that the alignment matches.

Whether a text can reach the coverage at all is told first by counting the template's words in it
(an upper bound, so nothing is lost). Templates of LONG words or more are aligned with the whole text, so
words put in between take nothing away. A text may also hold a notice several times, where no word is
unique; so the alignment runs, too, on stretches of the template's length around each occurrence of
the template's rarest words there, and the best alignment counts. Shorter templates are sought in
such stretches only: their words may stand far apart in any long text.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sumweave.llm import common as C

#: Notices by licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "all rights reserved": "All rights reserved.",
}
#: Share of a template's words to be matched; templates under SHORT words must match whole, those of LONG
#: words or more are sought in the whole text.
COVERAGE, SHORT, LONG = 0.8, 6, 20
PUNCTUATION = b".,;:!?\"'()[]{}<>*#/-_"

FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
FOUND_SQL = "doc_id long, license string, coverage double, first_word long, last_word long"


def normal(word: bytes) -> bytes:
    return word.lower().strip(PUNCTUATION)


def increasing(seq: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails, at, before = [], [], []
    for i, v in enumerate(seq):
        k = bisect.bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        there: dict = {}
        for j in range(b0, b1):
            there[b[j]] = -1 if b[j] in there else j
        anchors = [(i, there[w]) for w, i in once.items() if i >= 0 and there.get(w, -1) >= 0]
        anchors.sort()
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        out += kept
        if kept:
            at = (a0, b0)
            for i, j in [*kept, (a1, b1)]:
                todo.append((at[0], i, at[1], j))
                at = (i + 1, j + 1)
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = list(templates)
        split = [[w for x in t.encode().split() if (w := normal(x))] for t in templates.values()]
        vocab = {w: k + 1 for k, w in enumerate(sorted({w for s in split for w in s}))}
        self.size = len(vocab) + 1
        self.words = [[vocab[w] for w in s] for s in split]
        self.counts = np.array([np.bincount(s, minlength=self.size) for s in self.words])
        self.need = np.array([len(s) if len(s) < SHORT else coverage * len(s) for s in self.words])

        class Numbers(dict):
            def __missing__(self, raw: bytes) -> int:
                if len(self) >= C.CACHE:
                    self.clear()
                n = self[raw] = vocab.get(normal(raw), 0)
                return n

        self.number = Numbers()

    def scan(self, text: bytes):
        """(name, coverage, first, last word) of each template the text covers."""
        raw = text.split()
        w = np.fromiter(map(self.number.__getitem__, raw), np.int32, len(raw))
        have = np.bincount(w, minlength=self.size)
        for k in np.flatnonzero(np.minimum(self.counts, have).sum(axis=1) >= self.need - 1e-9).tolist():
            words = self.words[k]
            n = len(words)
            slack = max(2, n // 4)
            keys = sorted({x for x in words if have[x]}, key=lambda x: (have[x], words.index(x)))[: 1 + n - int(np.ceil(self.need[k] - 1e-9))]
            best = (0.0, 0, 0)
            if n >= LONG:
                at = np.flatnonzero(self.counts[k][w])
                match = patience(w[at].tolist(), words)
                if match:
                    best = (len(match) / n, int(at[match[0][0]]), int(at[match[-1][0]]))
            for x in keys if best[0] < 1 else ():
                for p in np.flatnonzero(w == x).tolist():
                    for q in (i for i, y in enumerate(words) if y == x):
                        lo, hi = max(0, p - q - slack), min(len(w), p - q + n + slack)
                        match = patience(w[lo:hi].tolist(), words)
                        if match and len(match) / n > best[0]:
                            best = (len(match) / n, lo + match[0][0], lo + match[-1][0])
                    if best[0] == 1:
                        break
                if best[0] == 1:
                    break
            if best[0] * n >= self.need[k] - 1e-9:
                yield self.names[k], *best


def _scan(templates: dict[str, str], coverage: float):
    def run(it):
        scanner = Scanner(templates, coverage)
        for b in it:
            out = {c: [] for c in FOUND.names}
            for d, t in zip(b.column("doc_id").to_pylist(), C.raw_texts(b), strict=True):
                for row in scanner.scan(t):
                    for c, v in zip(FOUND.names, (d, *row), strict=True):
                        out[c].append(v)
            yield C.batches(out, FOUND)

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word for each template a text covers.

    Words are compared with A-Z lowered and outer punctuation off. Null and empty texts hold
    nothing; texts are scanned whole, of any length. Of alignments with equal coverage the first found counts. Rows that repeat a doc_id are scanned each; a null doc_id is carried. Other columns
    are ignored; an empty table gives no rows.
    """
    C.prepare(docs.sparkSession)
    return C.id_text(docs).mapInArrow(_scan(dict(templates), coverage), FOUND_SQL)


def query(spark, sf_dir: str) -> DataFrame:
    """op7_license_scan."""
    return scan(C.table(spark, sf_dir, "documents"))
