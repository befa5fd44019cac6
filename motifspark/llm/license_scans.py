"""License scans (operator 2): exact containment join of templates with blocks of text.

Template words are ordered by how many rows of the corpus hold them, rarest first. A block becomes a
candidate of a template only through the template's prefix; length and positional filters go before
the exact count. Blocks are the lines of a text and, as notices are wrapped over lines, all windows
of 1/threshold times as many consecutive words as the template has, wherever lines end. Every block
that holds at least `threshold` of a template's words, and each of those that name the licence, is
found: a notice of another licence in the same words is none. Broadcast are the templates alone, which
are given with the query and do not grow.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import ALNUM, sliced, table

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public wordings of licence notices: label, words of which a block must hold each, text. Fixed values.
TEMPLATES = [
    ("apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "apache 2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("mit", "mit license", "Released under the MIT License"),
    ("mit", "mit license", "Licensed under the MIT License"),
    ("mit", "granted charge copy", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "granted charge sublicense",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistribution redistributions binary",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("bsd", "bsd license", "Licensed under the BSD License"),
    ("isc", "granted fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "freely misrepresented", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented"),
    ("gpl", "gnu general public", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "gnu general public",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("lgpl", "gnu lesser public", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "gnu affero public", "Licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "mozilla public", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mpl-2.0",
        "mozilla public mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "cc by nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "cc by nc sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc0", "cc0 public domain", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide under CC0 1.0"),
    ("unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain"),
]
THRESHOLD = Fraction(4, 5)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class Matcher:
    def __init__(self, templates, counts: dict[bytes, int], threshold: Fraction = THRESHOLD):
        sets = [(label, frozenset(words_of(must.encode())), frozenset(words_of(t.encode()))) for label, must, t in templates]
        for label, must, words in sets:
            if not must <= words:
                raise ValueError(f"a template of {label} lacks words that it asks for")
        sets = [s for s in sets if s[2]]
        self.rank = {w: i for i, w in enumerate(sorted(set().union(*(s for _, _, s in sets)), key=lambda w: (counts.get(w, 0), w)))}
        self.sets, self.prefix = [], {}
        for label, must, words in sets:
            need = -(-len(words) * threshold.numerator // threshold.denominator)
            ordered = sorted(words, key=self.rank.__getitem__)
            for place, word in enumerate(ordered[: len(words) - need + 1]):
                self.prefix.setdefault(word, []).append((len(self.sets), place))
            self.sets.append((label, words, need, must))
        self.spans = [-(-len(w) * threshold.denominator // threshold.numerator) for w in (words_of(t.encode()) for _, _, t in templates) if w]

    def candidates(self, block) -> dict[int, int]:
        """Numbers of the templates that the block holds to the threshold, with how many words it holds."""
        known = sorted(self.rank.keys() & set(block), key=self.rank.__getitem__)
        held, out, seen = set(known), {}, set()
        for at, word in enumerate(known):
            for number, place in self.prefix.get(word, ()):
                _, words, need, must = self.sets[number]
                if number in seen or len(known) < need or not must <= held:
                    continue
                seen.add(number)  # its first shared word: what is left on either side bounds the rest
                if min(len(words) - place, len(known) - at) >= need and (shared := len(words & held)) >= need:
                    out[number] = shared
        return out

    def _shares(self, held: dict[int, int]) -> dict[str, float]:
        out = {}
        for number, shared in held.items():
            label, words, *_ = self.sets[number]
            out[label] = max(out.get(label, 0.0), shared / len(words))
        return out

    def match(self, block: list[bytes]) -> dict[str, float]:
        """Labels of the templates that the block holds to the threshold, with the share held."""
        return self._shares(self.candidates(block))

    def windows(self, text: list[bytes]) -> dict[str, float]:
        """Labels of the templates that a window of the text's words holds to the threshold, with the
        largest share held. A text that does not hold enough words anywhere has no such window."""
        held = {}
        for number in self.candidates(text):
            _, words, need, must = self.sets[number]
            span, inside, best = self.spans[number], Counter(), 0
            places = [i for i, word in enumerate(text) if word in words]
            first = 0
            for place in places:
                inside[text[place]] += 1
                while places[first] <= place - span:
                    gone = text[places[first]]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    first += 1
                if len(inside) > best and must <= inside.keys():
                    best = len(inside)
            if best >= need:
                held[number] = best
        return self._shares(held)


def phrase_starts(words: list[bytes], phrase: list[bytes]) -> list[int]:
    joined, wanted, out, at = b" " + b" ".join(words) + b" ", b" " + b" ".join(phrase) + b" ", [], -1
    place = passed = 0
    while (at := joined.find(wanted, at + 1)) >= 0:
        place += joined.count(b" ", passed, at)
        passed = at
        out.append(place)
    return out


def word_counts(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Rows that hold each word of the vocabulary; no more rows than it has words reach the driver."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0):  # one text at a time
                seen.update(vocabulary & set(words_of(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    return {bytes(r["word"]): r["n"] for r in texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 with a base phrase, else the largest share of a template found, else 0. A null or
    empty text has no words, no labels and score 0. Null ids and repeated rows are kept; other
    columns are ignored. An empty input gives no rows. Templates are (label, words that a block must
    hold, text).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    vocabulary = {w for *_, t in templates for w in words_of(t.encode())}
    matcher = Matcher(templates, word_counts(rows.select("text"), vocabulary), threshold)
    wanted = [(words_of(p.encode()), label) for p, label in phrases.items()]

    def scan(text: bytes):
        words = words_of(text)
        held = set(words)
        starts, base, labels = [], set(), {}
        for phrase, label in wanted:
            if held.issuperset(phrase) and (found := phrase_starts(words, phrase)):
                starts += found
                base.add(label)
        if not held.isdisjoint(matcher.prefix):
            for found in (matcher.windows(words), *(matcher.match(words_of(block)) for block in text.split(b"\n"))):
                for label, share in found.items():
                    labels[label] = max(labels.get(label, 0.0), share)
        score = 1.0 if base else max(labels.values(), default=0.0)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels.keys())), round(score, 6)

    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def scans(batches):
        for batch in sliced(batches, 1):
            if batch.num_rows:
                found = zip(*(scan(t.as_py() or b"") for t in batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(found, kinds))], ["id", *(n for n, _ in kinds)])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scans, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)


def op2_license_scans(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def license_phrases(spark, sf_dir):
    """The columns of op2_license_scans that SQL can express."""
    return op2_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _places(phrase: str) -> str:
    return "[a FOR a IN range(len(w)) IF " + " AND ".join(f"w[a + {i}] = '{word}'" for i, word in enumerate(phrase.split(), 1)) + "]"


PHRASES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, {", ".join(f"{_places(phrase)} AS p{i}" for i, phrase in enumerate(PHRASES))} FROM d),
a AS (SELECT *, {" || ".join(f"p{i}" for i in range(len(PHRASES)))} AS every, {" || ".join(f"CASE WHEN len(p{i}) > 0 THEN ['{label}'] ELSE [] END" for i, label in enumerate(PHRASES.values()))} AS labels FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word, array_to_string(list_sort(labels), ',') AS base_labels FROM a"""
