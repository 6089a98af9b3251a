"""Licence scans by a positional index of rare tokens.

Templates are notices and the paragraphs of whole licences. By the IDF over the whole corpus, each template posts its rarest words with
their positions, until they hold as much weight as POSTED says. A file's licence words are looked up from its highest IDF down; a posting's
relative position, position in the text minus position in the template, gives a place of a template. Postings are intersected by
relative position: only a place at which posted words of enough weight agree is a candidate, as a place that counts lacks less than
1 - LEAST_SHARE of the weight. Candidates are aligned word by word and count only with the template's mandatory key phrase. Beside the
templates, base phrases are counted wherever their words stand consecutively.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import small_batches

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, notice or paragraph of a public licence, and a key phrase of it that must stand in the text word for word.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "to any person obtaining a copy of this software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "to any person obtaining a copy of this software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "permission notice shall be included in all copies or substantial portions"),
    ("mit", "under the mit license", "mit license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license version 2"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "distributed under the license is distributed on an as is basis"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution and use in source and binary forms"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "may be used to endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "for any purpose with or without fee is hereby granted"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "without any express or implied warranty"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public license"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free to copy modify publish use compile sell or distribute this software"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "to any person or organization obtaining a copy of the software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright and related"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: A place counts if as large a share of the template's words, by IDF, stands there.
LEAST_SHARE = 0.75
#: Share of a template's weight that its posted words hold; those of a place that counts hold LEAST_SHARE + POSTED - 1 of it at least.
POSTED = 0.6

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


_VOCABULARY = frozenset(w for _, t, _ in TEMPLATES for w in words_of(t))


def _seen_batches(batches):
    for batch in batches:
        found, total = Counter(), 0
        for text in batch.column("text").to_pylist():
            total += 1
            found.update(_VOCABULARY.intersection(words_of(text)))
        words = ["", *found]
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([total, *found.values()], pa.int64())})


def corpus_idf(texts: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all rows of texts(text); one row for each word comes to the driver."""
    counts = {r.word: r.n for r in texts.select("text").mapInArrow(_seen_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.get("", 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 0.01 for w in _VOCABULARY}


class Index:
    def __init__(self, idf: dict[str, float]):
        self.idf = idf
        self.templates = [(label, words_of(t), k.split(), sum(idf[w] for w in words_of(t))) for label, t, k in TEMPLATES]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.needed: list[float] = []
        for t, (_, words, _, weight) in enumerate(self.templates):
            posted = 0.0
            for p in sorted(range(len(words)), key=lambda p: (-idf[words[p]], p)):
                if posted >= POSTED * weight:
                    break
                self.postings.setdefault(words[p], []).append((t, p))
                posted += idf[words[p]]
            self.needed.append(posted - (1 - LEAST_SHARE) * weight - 1e-9)
        self.base = [(phrase.split(), label) for phrase, label in BASE.items()]

    def candidates(self, words: list[str]) -> list[tuple[int, int]]:
        """(template, start) at which posted words of enough weight agree."""
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.postings:
                places.setdefault(w, []).append(k)
        agreed: dict[tuple[int, int], float] = {}
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for t, p in self.postings[w]:
                for k in places[w]:
                    agreed[t, k - p] = agreed.get((t, k - p), 0.0) + self.idf[w]
        return sorted(x for x, weight in agreed.items() if weight >= self.needed[x[0]])

    def matches(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(template, start, share) of the places that count, the best place of each template."""
        best: dict[int, tuple[float, int]] = {}
        for t, start in self.candidates(words):
            _, template, key, weight = self.templates[t]
            fit = sum(self.idf[w] for p, w in enumerate(template) if 0 <= start + p < len(words) and words[start + p] == w) / weight
            if fit >= LEAST_SHARE and fit > best.get(t, (0.0, 0))[0] and self._holds(words, max(0, start), start + len(template), key):
                best[t] = (fit, start)
        return [(t, start, fit) for t, (fit, start) in sorted(best.items())]

    @staticmethod
    def _holds(words: list[str], a: int, b: int, phrase: list[str]) -> bool:
        return any(words[k : k + len(phrase)] == phrase for k in range(a, b - len(phrase) + 1))

    def base_places(self, words: list[str]) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.base:
            k, rare = -1, phrase[0]
            while True:
                try:
                    k = words.index(rare, k + 1)
                except ValueError:
                    break
                if words[k : k + len(phrase)] == phrase:
                    found.append((k, label))
        return found


def _scan_batches(idf: dict[str, float]):
    def run(batches):
        index = Index(idf)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                base, places = index.base_places(words), index.matches(words)
                base_labels = {x for _, x in base}
                labels = base_labels | {index.templates[t][0] for t, _, _ in places}
                score = 1.0 if base else max([fit for _, _, fit in places], default=0.0)
                starts = [k for k, _ in base]
                rows.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(1.0, score)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. Null and empty texts have no words, empty labels and
    score 0. Texts are read whole, repeated rows are scanned alike, a null doc_id stays null, other columns are not read. An empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches(corpus_idf(rows)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
