"""License scans: a positional index of each template's rarest words, intersected by relative position and verified."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Label and words of the phrases that count wherever they stand.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Label, words, and key phrases that must be among them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose", "with or without fee")),
    ("gpl-2", "gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3", "gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by", "creative commons attribution license", ("creative commons attribution",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0", "public domain dedication")),
)
#: Texts of licences and of the notices by which files put themselves under one: fixed values, the licences' own public
#: wording. Others, whole texts too, can be given to scan() in the same form.
NOTICES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.""", ("permission is hereby granted free of charge", "without restriction", "substantial portions of the software")),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.""", ("source and binary forms", "this list of conditions and the following disclaimer")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""", ("for any purpose with or without fee", "appear in all copies")),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""", ("apache license version 2", "governing permissions and limitations")),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", ("gnu general public license", "either version 3 of the license")),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", ("gnu general public license", "either version 2 of the license")),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", ("gnu lesser general public license", "free software foundation")),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", ("gnu affero general public license", "free software foundation")),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license v 2 0", "copy of the mpl")),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means.""", ("unencumbered software", "by any means")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions""", ("permission is granted to anyone to use this software", "alter it and redistribute it freely")),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""", ("any person or organization obtaining a copy", "prepare derivative works")),
)
#: Rare words of a template that are looked up, at least, and one more for each so many words; what share of its words a
#: match needs; how far a word may be off its place behind the one before.
RARE, MORE, COVER, SLACK = 4, 8, 0.8, 2
#: Bytes of words: letters and digits in lower case, and all beyond ASCII; every other byte parts words.
WORD_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def document_frequencies(docs: DataFrame, templates=(*TEMPLATES, *NOTICES)) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each word of the templates stands, and how many documents there are."""
    vocabulary = {w for _, t, *_ in (*PHRASES, *templates) for w in words_of(t)}

    def run(batches):
        found, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column("text"):
                found.update(vocabulary.intersection(words_of(text.as_py())))
        rows = [("", n), *((w.decode(), k) for w, k in found.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["word", "n"])

    counts = {r.word: r.n for r in docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: counts.get(w.decode(), 0) for w in vocabulary}, counts.get("", 0)


class Index:
    """For every rare word, the templates that have it and where."""

    def __init__(self, frequencies: dict[bytes, int], n: int, templates=(*TEMPLATES, *NOTICES)):
        idf = {w: math.log((n + 1) / (k + 1)) for w, k in frequencies.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.templates = []
        for label, text, keys in [(a, b, (b,)) for a, b in PHRASES] + list(templates):
            words, number = words_of(text), len(self.templates)
            base = number < len(PHRASES)
            rare = sorted(set(words), key=lambda w: (-idf[w], w))[: 1 if base else max(RARE, len(words) // MORE)]
            places = [k for k, w in enumerate(words) if w in rare]
            for k in places:
                self.postings[words[k]].append((number, k))
            self.templates.append((label, words, [words_of(k) for k in keys], base, min(len(places), 2)))
        self.rare = frozenset(self.postings)

    def scan(self, words: list[bytes]):
        """(places of phrases as (start, label), labels of all, score) of a document's words."""
        if self.rare.isdisjoint(words):
            return [], set(), 0.0
        starts: dict[int, Counter] = defaultdict(Counter)
        for at, word in enumerate(words):
            if word in self.rare:
                for number, k in self.postings[word]:
                    starts[number][at - k] += 1
        places, labels, score = [], set(), 0.0
        for number, votes in starts.items():
            label, template, keys, base, need = self.templates[number]
            if base:
                found = [s for s in votes if s >= 0 and words[s : s + len(template)] == template]
                places += [(s, label) for s in found]
                if found:
                    labels.add(label)
                    score = 1.0
                continue
            for s in votes:
                if sum(votes.get(s + d, 0) for d in range(-SLACK, SLACK + 1)) < need or (votes.get(s - 1, 0) > votes[s]):
                    continue
                cover, end = _covered(words, template, s)
                score = max(score, min(cover, 0.99) if cover < 1 else 1.0)
                if cover >= COVER and label not in labels:
                    window = words[max(0, s - SLACK) : end + SLACK]
                    if all(_stands(window, k) for k in keys):
                        labels.add(label)
        return places, labels, score


def _covered(words: list[bytes], template: list[bytes], start: int) -> tuple[float, int]:
    """What share of a template's words stand at their places from a start, and where the last place is. Words that are
    put in or left out, SLACK at once, move the places behind them."""
    found, drift = 0, 0
    for k, word in enumerate(template):
        at = start + k + drift
        for d in (0, *(sign * far for far in range(1, SLACK + 1) for sign in (1, -1))):
            if 0 <= at + d < len(words) and words[at + d] == word:
                found, drift = found + 1, drift + d
                break
    return found / len(template), start + len(template) + drift


def _stands(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[k : k + len(phrase)] == phrase for k in range(len(words) - len(phrase) + 1))


def scan(docs: DataFrame, index: Index | None = None, templates=(*TEMPLATES, *NOTICES)) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Whole texts are scanned. A null or empty text has no words, no places (null first_word and last_word), empty label
    lists and score 0. The score is the best share of a template's words that stand where it has them. The index's
    rarity is measured over all of docs first; it decides which words are looked up, never which phrases are found.
    templates: (label, text, phrases that must be in it) of any length. Repeated rows and null ids come back as often as
    they are there; other columns are not read, whatever their names; an empty table gives an empty result.
    """
    index = index or Index(*document_frequencies(docs, templates), templates)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part, out = batch.slice(k, 1024), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    words = words_of(text.as_py())
                    places, labels, score = index.scan(words)
                    at = [s for s, _ in places]
                    out.append((doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score))
                if out:
                    kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of every document: nulls, empty, long and repeated texts as it says."""
    return scan(table(spark, sf_dir, "documents"))
