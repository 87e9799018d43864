"""License notices by a positional rare-token index.

All words of the templates are indexed: word to postings (template, place in it). Of each file, the licence words with
the highest inverse document frequency over the corpus are looked up, RARE for each template that could stand in it;
their postings, taken at the words' places in the file, agree on where a template would begin. There it is compared word
by word, and reported if its mandatory key phrases stand in it too. The contract's phrases are templates of their own,
all of whose words must stand in place.

The corpus is read once: that pass counts in how many files each licence word is, and keeps the places of such words for
files in which some template has SHARE of its words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stored, whole_text

#: Words of a file that are looked up for each template; all of a contract phrase are.
RARE = 4
#: Of a template's words, the share that must stand in place, so many places aside at most.
SHARE, SLACK = 0.7, 3

# The phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# Public licences and the usual notices of them, with the phrases that must stand in them.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard
to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct
indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence
or other tortious action arising out of or in connection with the use or performance of this software"""
_BSD_2 = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution"""
_BSD_3 = """3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission"""
_BSD_END = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors
be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods
or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability
or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the
public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim
that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is
not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may
not be removed or altered from any source distribution"""
_BOOST = """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the
software and to permit third parties to whom the software is furnished to do so all subject to the following"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software
foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but
without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details"""
_MPL = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
you can obtain one at https mozilla org mpl 2 0"""

TEMPLATES = (
    Template("mit", _MIT, ("permission is hereby granted", "this software and associated documentation files")),
    Template("isc", _ISC, ("with or without fee is hereby granted",)),
    Template("bsd", f"{_BSD_2} {_BSD_END}", ("redistribution and use in source and binary forms",)),
    Template("bsd", f"{_BSD_2} {_BSD_3} {_BSD_END}", ("redistribution and use in source and binary forms",)),
    Template("apache-2", _APACHE, ("apache license version 2",)),
    Template("unlicense", _UNLICENSE, ("free and unencumbered software",)),
    Template("zlib", _ZLIB, ("must not be misrepresented",)),
    Template("bsl-1", _BOOST, ("any person or organization obtaining a copy",)),
    Template("gpl-2", _GPL.format("general public license", "2"), ("gnu general public license", "version 2 of the license")),
    Template("gpl-3", _GPL.format("general public license", "3"), ("gnu general public license", "version 3 of the license")),
    Template("lgpl", _GPL.format("lesser general public license", "2 1"), ("gnu lesser general public license",)),
    Template("lgpl", _GPL.format("lesser general public license", "3"), ("gnu lesser general public license",)),
    Template("agpl-3", _GPL.format("affero general public license", "3"), ("gnu affero general public license",)),
    Template("mpl-2", _MPL, ("mozilla public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "this software and associated documentation files")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: A-Z to lower case; all other ASCII that is no letter or digit to a space; UTF-8 bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Index:
    """The templates' words as numbers, with their postings; the contract's phrases are the last templates."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        texts = [(t.label, t.text.encode().split(), [k.encode().split() for k in t.keys], SHARE) for t in templates]
        texts += [(label, phrase.encode().split(), [phrase.encode().split()], 1.0) for phrase, label in BASE]
        self.first_base = len(templates)
        self.words = sorted({w for _, words, _, _ in texts for w in words})
        self.number = {w: i for i, w in enumerate(self.words)}
        numbered = lambda words: [self.number[w] for w in words]
        self.templates = [(label, np.array(numbered(words)), [numbered(k) for k in keys], share) for label, words, keys, share in texts]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.holds = np.zeros((len(self.words), len(self.templates)), np.int32)  # how often a word is in a template
        for k, (_, words, _, _) in enumerate(self.templates):
            for place, w in enumerate(words.tolist()):
                self.postings[w].append((k, place))
                self.holds[w, k] += 1
        self.needed = np.array([math.ceil(share * len(words)) for _, words, _, share in self.templates])

    def possible(self, known: list[int]) -> np.ndarray:
        """The templates of whose words enough are among a file's licence words."""
        return np.flatnonzero(self.holds[known].sum(0) >= self.needed) if known else np.zeros(0, np.int64)

    def looked_up(self, known: list[int], possible: np.ndarray, idf: np.ndarray) -> set[int]:
        """The file's words with the highest inverse document frequency, RARE for each template that is possible, or all where all must stand."""
        left = {int(k): RARE if share < 1 else len(words) for k in possible for _, words, _, share in [self.templates[k]]}
        out = set()
        for w in sorted(known, key=lambda w: (-idf[w], w)):
            meant = [k for k in left if self.holds[w, k] and left[k] > 0]
            if meant:
                out.add(w)
                for k in meant:
                    left[k] -= 1
        return out

    def scan(self, places: np.ndarray, numbers: np.ndarray, idf: np.ndarray) -> tuple[list[tuple[int, str]], set[str], float]:
        """Of a file's licence words (ascending places, their numbers): (place, label) of each contract phrase, the other labels, and the best share of a template's words in place."""
        known = sorted(set(numbers.tolist()))
        possible = self.possible(known)
        if not len(possible):
            return [], set(), 0.0
        wanted, at = self.looked_up(known, possible, idf), dict(zip(places.tolist(), numbers.tolist(), strict=True))
        allowed = set(possible.tolist())
        agree: dict[tuple[int, int], set[int]] = defaultdict(set)
        for place, w in at.items():
            if w in wanted:
                for k, own in self.postings[w]:
                    if k in allowed:
                        agree[k, place - own].add(w)
        base, labels, best = [], set(), 0.0
        for (k, begin), by in agree.items():
            label, template, keys, share = self.templates[k]
            if k >= self.first_base:
                if all(at.get(begin + j) == w for j, w in enumerate(template.tolist())):
                    base.append((begin, label))
                    best = 1.0
            elif len(by) > 1 and (same := self.in_place(places, numbers, begin, template)) >= share and all(self.stands(at, begin, len(template), key) for key in keys):
                labels.add(label)
                best = max(best, same)
        return base, labels, best

    def in_place(self, places: np.ndarray, numbers: np.ndarray, begin: int, template: np.ndarray) -> float:
        """The share of a template's words that stand where they should, or up to SLACK places off."""
        low, high = np.searchsorted(places, [begin - SLACK, begin + len(template) + SLACK])
        own, found = places[low:high] - begin, numbers[low:high]
        there = np.zeros(len(template), bool)
        for off in range(-SLACK, SLACK + 1):
            to = own + off
            fits = (to >= 0) & (to < len(template))
            there[to[fits]] |= template[to[fits]] == found[fits]
        return float(there.mean())

    def stands(self, at: dict[int, int], begin: int, length: int, key: list[int]) -> bool:
        """Whether a key phrase stands, word for word, in a template's place."""
        return any(all(at.get(b + j) == w for j, w in enumerate(key)) for b in range(begin - SLACK, begin + length + SLACK))


#: A-Z to lower case; all other ASCII that is no letter or digit to a space; UTF-8 bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


READ = "doc_id long, n_words long, places binary, numbers binary, word int, files long"


def read_words(docs: DataFrame, index: Index) -> DataFrame:
    """A row for each document: doc_id, n_words and, where a template is possible, places and numbers of its licence words; and rows (word, files) of a partition's document frequencies, word -1 for all files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, files, count = index.number, np.zeros(len(index.words), np.int64), 0
        names = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            sizes, places, numbers = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                known = [number[w] for w in number.keys() & set(words)]
                files[known] += 1
                count += 1
                sizes.append(len(words))
                if len(index.possible(known)):
                    hits = [(i, number[w]) for i, w in enumerate(words) if w in number]
                    both = np.array(hits, "<i4").T
                    places.append(both[0].tobytes())
                    numbers.append(both[1].tobytes())
                else:
                    places.append(None)
                    numbers.append(None)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, pa.binary()), pa.array(numbers, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
        k = len(files) + 1
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())), pa.array(range(-1, k - 1), pa.int32()), pa.array([count, *files.tolist()], pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text")).mapInArrow(read, READ)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row for each document (doc_id, text): its words, base phrases, labels and score.

    The score is the best share of a template's words that stand in place. Null and empty texts have no words, empty
    label strings, null places and score 0. Null ids stay null, repeated rows give repeated rows, a long text is one
    row's work; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    index = Index(templates)
    seen = stored(read_words(docs, index), "words")
    counts = {r["word"]: r["n"] for r in seen.filter("word is not null").groupBy("word").agg(F.sum("files").alias("n")).collect()}  # a row a licence word
    files = np.array([counts.get(i, 0) for i in range(len(index.words))])
    idf = np.log((1 + counts.get(-1, 0)) / (1 + files))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places, numbers in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                base, labels, score = index.scan(np.frombuffer(places, "<i4"), np.frombuffer(numbers, "<i4"), idf)
                known = {label for _, label in base}
                out.append((len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted(known)), ",".join(sorted(known | labels)), score))
            types = (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = seen.filter("word is null")
    found = rows.filter("places is not null").select("doc_id", "n_words", "places", "numbers").mapInArrow(scan, SCHEMA)
    none = [F.lit(v).cast(t).alias(n) for n, t, v in (("n_base", "long", 0), ("first_word", "long", None), ("last_word", "long", None), ("base_labels", "string", ""), ("labels", "string", ""), ("score", "double", 0))]
    return reduce(DataFrame.unionByName, (rows.filter("places is null").select("doc_id", "n_words", *none), found))
