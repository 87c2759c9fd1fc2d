"""Licence scans by a positional index of rare words.

Templates are pieces of public licence texts without blanks to fill in, each with mandatory key phrases. Inverse document
frequencies of the licence words are counted over all scanned files. The index posts, for each template, the ``POSTED``
rarest words of its key phrases with their offsets. In a file the positions of these words are looked up, its words of highest
inverse document frequency first; each occurrence implies a start of the template by its offset, and the starts that the
postings of a template imply are intersected, so that only places remain where its rare words stand at the right distances.
There all key phrases must be complete. A complete phrase holds its rarest words, so no place is missed.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import map_rows, table

# The base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

POSTED = 3
# Wording of public licences and licence notices, and the phrases of each that must be complete.
TEMPLATES = [
    ("mit", "released under the MIT License", ["the mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["free of charge to any person obtaining a copy of this software and associated documentation"]),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ["to deal in the software without restriction", "and to permit persons to whom the software is furnished to do so"]),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", ["the software is provided as is without warranty of any kind", "particular purpose and noninfringement"]),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license version 2 0", "may not use this file except in compliance with the license"]),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", ["required by applicable law or agreed to in writing", "as is basis without warranties or conditions of any kind"]),
    ("gpl-2.0", "this work is licensed under the GNU General Public License version 2", ["general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the GNU General Public License version 3", ["general public license version 3"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["you can redistribute it and or modify it under the terms of", "the gnu general public license as published by the free software foundation"]),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", ["distributed in the hope that it will be useful but without any warranty", "gnu general public license for more details"]),
    ("lgpl", "this library is licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl", "this program is licensed under the GNU Affero General Public License", ["gnu affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license v 2 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "with or without modification are permitted"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistributions of source code must retain the above copyright notice"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["distribute this software for any purpose with or without fee"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software"]),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright under CC0 1.0 Universal", ["cc0 1 0 universal"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ["cc by nd 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0 international"]),
]

#: All bytes below 0x80 but digits and lower-case letters part words (texts are lower-cased first).
PARTING = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(PARTING).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]  # where each starts, and its words
    base: bool

    @staticmethod
    def of(label: str, text: str, phrases: list[str], base: bool = False) -> Template:
        words, placed = words_of(text), []
        for phrase in map(words_of, phrases):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            placed.append((at, tuple(phrase)))
        return Template(label, tuple(words), tuple(placed), base)

    def stands(self, words: list[bytes], start: int) -> bool:
        """Whether all key phrases are complete where this start puts them."""
        return all(start + at >= 0 and tuple(words[start + at : start + at + len(p)]) == p for at, p in self.phrases)


def all_templates() -> list[Template]:
    base = [Template.of(label, phrase, [phrase], base=True) for phrase, label in BASE_PHRASES.items()]
    return base + [Template.of(*t) for t in TEMPLATES]


def document_frequencies(docs: DataFrame, templates: list[Template], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Over all documents: how many there are, and in how many each word of the templates occurs."""
    known = frozenset(w for t in templates for w in t.words)

    def rows(columns):
        seen: Counter = Counter()
        for text in columns[0]:
            seen.update(known.intersection(words_of(text)))
        yield b"", len(columns[0])
        yield from seen.items()

    counted = map_rows(docs.select(F.col(text_col).cast("string")), "word binary, n long", rows).groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r.word): r.n for r in counted.collect()}  # a row for each word of the templates at most
    return found.pop(b"", 0), found


class Index:
    """Postings of the rarest words of the templates' key phrases, and the weights of all their words."""

    def __init__(self, templates: list[Template], total: int, frequency: dict[bytes, int]):
        self.templates = templates
        self.idf = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) + 1 for t in templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int, int]]] = {}  # template, offset, how many words of it are rarer
        self.posted: list[int] = []
        self.rarest: set[bytes] = set()
        for i, t in enumerate(templates):
            offsets = sorted({at + k for at, p in t.phrases for k in range(len(p))}, key=lambda o, t=t: (*self.rank(t.words[o]), o))[:POSTED]
            self.posted.append(len(offsets))
            self.rarest.add(t.words[offsets[0]])
            for nth, o in enumerate(offsets):
                self.postings.setdefault(t.words[o], []).append((i, o, nth))
        self.weight = [sum(self.idf[w] for w in t.words) for t in templates]

    def rank(self, word: bytes) -> tuple[float, bytes]:
        return -self.idf[word], word

    def places(self, words: list[bytes]) -> dict[tuple[int, int], float]:
        """(template, its start among the words) with the share of the template's weight that stands there."""
        found: dict[tuple[int, int], float] = {}
        if self.rarest.isdisjoint(words):  # no template without its rarest word
            return found
        where: dict[bytes, list[int]] = {}
        for at, word in enumerate(words):
            if word in self.postings:
                where.setdefault(word, []).append(at)
        agreed: dict[int, tuple[int, set[int]]] = {}  # template: postings met, and the starts that all of them imply
        for word in sorted(where, key=self.rank):  # the file's licence words of highest inverse document frequency first
            for i, offset, nth in self.postings[word]:
                met, starts = agreed.get(i, (0, set()))
                if met == nth:  # else a rarer word of the template is missing
                    implied = {at - offset for at in where[word]}
                    agreed[i] = nth + 1, implied if nth == 0 else starts & implied
        for i, (met, starts) in agreed.items():
            t = self.templates[i]
            if met == self.posted[i]:
                for start in starts:
                    if t.stands(words, start):
                        same = sum(self.idf[w] for k, w in enumerate(t.words) if 0 <= start + k < len(words) and words[start + k] == w)
                        found[i, start] = same / self.weight[i]
        return found

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        found = self.places(words)
        base = [(start, self.templates[i]) for i, start in found if self.templates[i].base]
        labels = {self.templates[i].label for i, _ in found}
        return (
            len(words), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None),
            ",".join(sorted({t.label for _, t in base})), ",".join(sorted(labels)), min(1.0, max(found.values(), default=0.0)),
        )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per input row.

    ``labels`` has those of all templates that stand in the text, the base phrases' among them; the labels of both lists are
    distinct and sorted. Null and empty texts have no words, no labels (empty strings) and score 0; first_word and last_word are null where
    no base phrase stands. Ids may be null, repeated rows are repeated, an empty table gives no row. The score is the
    largest share (by inverse document frequency) of a template's words that stand around its complete key phrases.
    """
    templates = templates or all_templates()
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates, *document_frequencies(docs, templates, text_col)))

    def rows(columns):
        index = sent.value
        for i, text in zip(*columns, strict=True):
            yield i, *index.scan(text)

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, rows)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
