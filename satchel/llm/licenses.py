"""Operator 7: licence scans with a generalised suffix automaton of template words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from satchel.llm.automaton import SuffixAutomaton
from satchel.llm.common import bare, tidy

#: Fixed values of the contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices in wide use, as words; a label may have several.
TEMPLATES = {
    "apache": ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "cc-by-nc": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"),
    "gnu-gpl": ("this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "zlib": ("in no event will the authors be held liable for any damages arising from the use of this software",),
}

#: Whole licences, public texts and fixed values, beside their notices above.
TEXTS = {
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
}
TEMPLATES = {label: (*notices, TEXTS[label]) if label in TEXTS else notices for label, notices in TEMPLATES.items()}

_WORD_BYTES = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def license_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(_WORD_BYTES).split()


@dataclass
class Scan:
    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)
    #: (label, first word, one past the last word, share of the template covered)
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)


class LicenseScanner:
    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: int = 3, gap: int = 5, share: float = 0.8):
        self.least, self.gap, self.share = least, gap, share
        self.phrases = {tuple(license_words(p.encode())): label for p, label in base.items()}
        self.templates = [(label, license_words(t.encode())) for label, texts in templates.items() for t in texts]
        self.automaton = a = SuffixAutomaton()
        for words in [*self.phrases, *(w for _, w in self.templates)]:
            a.add(list(words))
        self.vocabulary = {w for words in [*self.phrases, *(w for _, w in self.templates)] for w in words}
        at = {a.walk(p): (label, len(p)) for p, label in self.phrases.items()}
        #: Phrases that end where a state ends, and places in templates that do.
        self.phrases_at = [[at[s] for s in a.suffix_path(k) if s in at] for k in range(len(a.link))]
        places: list[set[tuple[int, int]]] = [set() for _ in a.link]
        for t, (_, words) in enumerate(self.templates):
            state = 0
            for i, w in enumerate(words):
                state = a.next[state][w]
                for s in a.suffix_path(state):
                    places[s].add((t, i + 1))
        self.places = [sorted(p) for p in places]

    def scan(self, text: bytes) -> Scan:
        """One pass: matching statistics against the automaton, then chains of long matches."""
        words = license_words(text)
        out, known = Scan(len(words)), self.vocabulary
        hits = [i for i, w in enumerate(words) if w in known]
        matches: list[tuple[int, int, int]] = []  # end, length, state
        step, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state = size = 0
        for k, i in enumerate(hits):
            if k and hits[k - 1] != i - 1:
                if size >= self.least:
                    matches.append((hits[k - 1] + 1, size, state))
                state = size = 0
            w = words[i]
            if w not in step[state]:
                if size >= self.least:
                    matches.append((i, size, state))
                while state and w not in step[state]:
                    state = link[state]
                    size = length[state]
            if w in step[state]:
                state, size = step[state][w], size + 1
            for label, n in self.phrases_at[state]:
                if n <= size:
                    out.places.append((i - n + 1, label))
        if hits and size >= self.least:
            matches.append((hits[-1] + 1, size, state))
        if matches:
            out.spans = self._chain(matches)
        return out

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in matches:
            for t, at in self.places[state]:
                if at >= size:
                    by.setdefault(t, []).append((end - size, at - size, size))
        spans = []
        for t, found in by.items():
            label, words = self.templates[t]
            # covered words and first word of the best chain, by its end in the text and in the template;
            # starts never go back, so ends out of reach stay so
            best: dict[int, dict[int, tuple[int, int]]] = {}
            for i, at, size in found:
                covered, first = size, i
                for end in [e for e in best if e < i - self.gap]:
                    del best[end]
                for end, chains in best.items():
                    if end <= i:
                        for place in range(at - self.gap, at + 1):
                            if place in chains and chains[place][0] + size > covered:
                                covered, first = chains[place][0] + size, chains[place][1]
                best.setdefault(i + size, {})[at + size] = covered, first
                if covered / len(words) >= self.share:
                    spans.append((label, first, i + size, covered / len(words)))
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def license_spans(docs: DataFrame, **options) -> DataFrame:
    """Covered template spans: doc_id, label, first_word, end_word, share; none for null texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(**options)
        for batch in batches:
            rows = [(i, *s) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True) for s in scanner.scan(t or b"").spans]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "label", "first_word", "end_word", "share"])

    return bare(docs).mapInArrow(tidy(scan), "doc_id long, label string, first_word long, end_word long, share double")


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """Per document: n_words, places of base phrases, labels of both kinds and a score.

    score is the largest share of a template that a chain covers, 1 where a base phrase stands, else 0.
    A null or empty text has no words, no labels ('') and score 0; every row has its result.  An empty table
    stays empty.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(**options)
        for batch in batches:
            found = [scanner.scan(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            starts = [[i for i, _ in f.places] for f in found]
            base = [{label for _, label in f.places} for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f.n_words for f in found], pa.int64()),
                    pa.array(map(len, starts), pa.int64()),
                    pa.array([min(s, default=None) for s in starts], pa.int64()),
                    pa.array([max(s, default=None) for s in starts], pa.int64()),
                    pa.array([",".join(sorted(b)) for b in base], pa.string()),
                    pa.array([",".join(sorted(b | {s[0] for s in f.spans})) for b, f in zip(base, found, strict=True)], pa.string()),
                    pa.array([1.0 if f.places else max((s[3] for s in f.spans), default=0.0) for f in found], pa.float64()),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return bare(docs).mapInArrow(tidy(scan), schema)
